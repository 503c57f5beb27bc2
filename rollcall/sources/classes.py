"""Classes of the knowledge base that route and type a dump's items.

Occupations are too many to state here; they are a file, ``qid,kind,type`` with a header,
that ``class_rows`` reads beside these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids of classes by kind and type, in order; of an id that comes twice in a kind the last one counts.
POSITIONS = (
    ("executive", (
        "Q484876", "Q623279", "Q1502675", "Q935019", "Q1057716", "Q2140589", "Q1115042", "Q4720025", "Q60432825", "Q15967139", "Q15729310", "Q47523568",
        "Q258557", "Q114863313", "Q726114", "Q1372944", "Q18918145", "Q1057569", "Q24058752", "Q3578048", "Q476675", "Q5441744", "Q4188234", "Q38844673",
        "Q97273203", "Q60715311", "Q3563879", "Q3505845",
    )),
    ("politician", (
        "Q30461", "Q14212", "Q83307", "Q2285706", "Q48352", "Q116", "Q382617", "Q212071", "Q1553195", "Q1670573", "Q13218630", "Q581682", "Q4175034",
        "Q486839", "Q193391", "Q484529", "Q1711695", "Q18941264", "Q16707842", "Q18015642", "Q17295570", "Q27169", "Q64366569", "Q19823090", "Q18229048",
        "Q21032547", "Q64511800", "Q50393121", "Q18558055", "Q109862831", "Q63078776", "Q83767637", "Q4382506", "Q17765219", "Q1752514", "Q18824436",
        "Q294414", "Q889821", "Q15966511", "Q334344", "Q16533", "Q3099732", "Q1500443", "Q611644", "Q2824523",
    )),
)
ROLES = (
    ("position", (
        "Q4164871", "Q294414", "Q12737077", "Q28640", "Q66715801", "Q88789639", "Q4220920", "Q15839299", "Q58635633", "Q66666607", "Q137841866",
        "Q63188683", "Q63188808", "Q138348066", "Q63187345", "Q66811410", "Q15987302", "Q3139516", "Q91188763", "Q6857706", "Q103810966", "Q110749524",
        "Q83856136", "Q56604560", "Q17279032", "Q108377574", "Q135106813", "Q137847894", "Q138024519", "Q138061574", "Q138348131", "Q16335296", "Q16631188",
        "Q3922583", "Q349843", "Q57260825", "Q828803", "Q214339", "Q355567", "Q3320743", "Q486983", "Q4226220", "Q1474521", "Q621504", "Q1221033",
        "Q108392111", "Q98038492", "Q108300140", "Q119982961", "Q11488158", "Q20827480", "Q3529618", "Q480319", "Q136649946", "Q187588", "Q189970",
        "Q2285706", "Q1553195", "Q30185", "Q15618781", "Q740464", "Q4185145", "Q107711", "Q4175034", "Q56019", "Q4338774", "Q15711026", "Q193391",
        "Q736600", "Q1075651",
    )),
)
ORGANIZATIONS = (
    ("business", (
        "Q4830453", "Q6881511", "Q783794", "Q891723", "Q167037", "Q658255", "Q206652", "Q22687", "Q1145276", "Q46970", "Q613142", "Q507619", "Q2979960",
        "Q1631111", "Q187652", "Q43229", "Q4671277", "Q1664720", "Q15911314", "Q15925165", "Q5225895", "Q161726", "Q134161", "Q1589009", "Q270791",
        "Q1762059", "Q17127659", "Q2695280", "Q1624464", "Q1668024", "Q3914", "Q1030034", "Q1370614", "Q1785271", "Q4686042", "Q431289", "Q622438",
        "Q6500733", "Q2659904", "Q1065118", "Q179179", "Q210167", "Q18388277", "Q1762913", "Q18558478", "Q6463968", "Q2864737", "Q161380", "Q15850590",
        "Q1048835", "Q1254933", "Q294414",
    )),
    ("fund", ("Q45400320", "Q476028", "Q380649", "Q1377053", "Q3312546", "Q751705", "Q2296920", "Q2824951", "Q1755098",)),
    ("nonprofit", ("Q163740",)),
    ("ngo", ("Q79913",)),
    ("foundation", ("Q157031",)),
    ("nonprofit", ("Q48204", "Q988108", "Q476436", "Q3591957", "Q162633", "Q270791", "Q484652",)),
    ("government", ("Q327333",)),
    ("political_party", ("Q7278",)),
    ("trade_union", ("Q178790",)),
    ("government", ("Q7188", "Q2659904", "Q35798", "Q35749", "Q12076836", "Q17362920", "Q1063239", "Q3624078", "Q133442", "Q174834",)),
    ("international_org", ("Q484652", "Q1335818", "Q1616075",)),
    ("educational", ("Q2385804", "Q3918",)),
    ("research", ("Q31855",)),
    ("educational", ("Q875538", "Q23002039", "Q38723", "Q1371037", "Q9842", "Q189004", "Q1188663",)),
    ("research", ("Q1321960", "Q31855", "Q3354859", "Q1298668",)),
    ("healthcare", ("Q16917", "Q1774898", "Q180958", "Q4260475", "Q871964", "Q902104",)),
    ("sports", ("Q847017", "Q476068", "Q12973014", "Q14350", "Q20639847", "Q13393265", "Q13406463", "Q1410877", "Q18558301", "Q2093802", "Q5137836",)),
    ("media", (
        "Q18127", "Q1366047", "Q1137109", "Q11032", "Q1002697", "Q5398426", "Q1110794", "Q1616075", "Q14350", "Q15265344", "Q131436", "Q1616075", "Q41298",
        "Q30022", "Q17232649", "Q28803812", "Q159334",
    )),
    ("religious", ("Q9174", "Q1530022", "Q2994867", "Q34651", "Q44613",)),
)
LOCATIONS = (
    ("continent", ("Q5107",)),
    ("country", ("Q6256",)),
    ("sovereign_state", ("Q3624078",)),
    ("dependent_territory", ("Q161243",)),
    ("country", ("Q15634554", "Q1763527",)),
    ("dependent_territory", ("Q46395",)),
    ("us_state", ("Q35657",)),
    ("us_county", ("Q47168",)),
    ("state_of_australia", ("Q5852411",)),
    ("state_of_germany", ("Q1221156",)),
    ("state_of_india", ("Q131541",)),
    ("department_france", ("Q6465",)),
    ("prefecture_japan", ("Q50337",)),
    ("canton_switzerland", ("Q23058",)),
    ("autonomous_community_spain", ("Q10742",)),
    ("voivodeship_poland", ("Q150093",)),
    ("oblast_russia", ("Q835714",)),
    ("province", ("Q34876",)),
    ("region", ("Q82794",)),
    ("county", ("Q28575",)),
    ("region", ("Q10864048",)),
    ("county", ("Q11828004",)),
    ("region", ("Q12483", "Q515716",)),
    ("county", ("Q1132541",)),
    ("region", ("Q1780990",)),
    ("county", ("Q211690", "Q180673", "Q1136601",)),
    ("region", ("Q21451686", "Q1006876",)),
    ("province", ("Q179872",)),
    ("region", ("Q1352230",)),
    ("province", ("Q13360155",)),
    ("region", ("Q842112",)),
    ("municipality", ("Q1348006",)),
    ("city", ("Q11774097", "Q515",)),
    ("big_city", ("Q1549591",)),
    ("capital", ("Q5119",)),
    ("town", ("Q3957",)),
    ("municipality", ("Q15284",)),
    ("village", ("Q532",)),
    ("hamlet", ("Q5084",)),
    ("commune_france", ("Q484170",)),
    ("municipality_germany", ("Q262166",)),
    ("municipality_japan", ("Q1054813",)),
    ("city", ("Q7930989",)),
    ("big_city", ("Q200250", "Q2264924", "Q174844",)),
    ("city", ("Q22865",)),
    ("municipality", ("Q5153359",)),
    ("village", ("Q4286337", "Q486972",)),
    ("city", ("Q95993392",)),
    ("district", ("Q149621",)),
    ("borough", ("Q5765681",)),
    ("neighborhood", ("Q123705",)),
    ("ward", ("Q12813115",)),
    ("borough", ("Q2198484",)),
    ("district", ("Q667509", "Q2100709",)),
    ("former_country", ("Q3024240",)),
    ("ancient_civilization", ("Q28171280",)),
    ("historic_territory", ("Q1620908", "Q19953632", "Q1307214",)),
)
# A few occupations, for use without a file.
OCCUPATIONS = (
    ("politician", ("Q82955",)),
    ("artist", ("Q1028181", "Q36180", "Q177220", "Q33999",)),
    ("athlete", ("Q937857",)),
    ("journalist", ("Q1930187",)),
)
KINDS = {"position": POSITIONS, "occupation": OCCUPATIONS, "role": ROLES, "organization": ORGANIZATIONS, "location": LOCATIONS}
SCHEMA = "qid string, kind string, type string"


def class_rows(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``qid, kind, type`` of every class, an id once in each kind; the rows of a file come after the stated ones."""
    stated = {(qid, kind): name for kind, table in KINDS.items() for name, ids in table for qid in ids}
    rows = spark.createDataFrame([(qid, kind, name) for (qid, kind), name in stated.items()], SCHEMA)
    if path is None:
        return rows
    more = spark.read.csv(path, header=True, schema=SCHEMA).dropDuplicates(["qid", "kind"])
    return rows.join(more, ["qid", "kind"], "left_anti").unionByName(more)
