"""Column expressions on names, roles and identifiers.

All are built from regular expressions without look-around and plain functions, so they
stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Legal forms that end a company's name.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "gmbh", "ag",
    "sa", "sas", "nv", "bv", "ab", "oy", "asa", "spa", "srl", "sarl", "pty", "pte", "kg", "kk", "se", "sec",
)
# What may stand before or after a person's name.
TITLES = ("dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "lord", "lady", "hon", "rev", "judge", "justice", "sen", "rep", "gov", "gen", "col", "capt")
HONOURS = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "mba", "cpa", "cbe", "obe", "mbe", "qc", "kc", "jd")
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bill": "william", "will": "william", "jim": "james", "mike": "michael", "tom": "thomas",
    "dick": "richard", "rick": "richard", "joe": "joseph", "dave": "david", "steve": "steven", "chris": "christopher", "dan": "daniel",
    "matt": "matthew", "tony": "anthony", "ed": "edward", "liz": "elizabeth", "kate": "katherine", "sue": "susan",
}
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


COMPANY_END = rf"(?:(?:^| ){_any(LEGAL_FORMS)})+$"
TITLE_START = rf"^(?:{_any(TITLES)}(?: |$))+"
HONOUR_END = rf"(?:(?:^| ){_any(HONOURS)})+$"
MIDDLE_INITIALS = r"^([^ ]+)(?: [^ ])+ "


def normalize_company(name: Column) -> Column:
    """Lower case, punctuation to single spaces, legal forms at the end dropped; null stays null."""
    plain = F.trim(F.regexp_replace(F.lower(name), _PUNCTUATION, " "))
    return F.trim(F.regexp_replace(plain, COMPANY_END, ""))


def normalize_person(name: Column) -> Column:
    """Titles, honours and middle initials dropped, a nickname in first place spelled out."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[.']", ""), _PUNCTUATION, " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, TITLE_START, ""), HONOUR_END, ""))
    bare = F.regexp_replace(bare, MIDDLE_INITIALS, "$1 ")
    first = F.substring_index(bare, " ", 1)
    nicknames = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    return F.concat(F.coalesce(F.element_at(nicknames, first), first), F.substring(bare, F.length(first) + 1, F.length(bare)))


def normalize_plain(name: Column) -> Column:
    """Normal form of roles and locations."""
    return F.lower(F.trim(name))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 for equal names in any case, 0 if just one is empty, else 1 less the edit distance over the longer length."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return (
        F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1.0 - F.levenshtein(x, y) / longest)
    )


def org_names_match(a: Column, b: Column, least: int = 4) -> Column:
    """Equal normal forms, or the shorter one, of at least four characters, inside the longer."""
    x, y = normalize_company(a), normalize_company(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | ((F.length(short) >= least) & F.contains(long, short))


def title_case(name: Column) -> Column:
    """White space squeezed, a capital after every character that is no letter."""
    letters = F.split(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), "")
    initial = F.transform(
        letters, lambda c, i: F.when((i == 0) | ~F.rlike(F.coalesce(F.get(letters, i - 1), F.lit(" ")), F.lit(r"\p{L}")), F.upper(c)).otherwise(c)
    )
    return F.array_join(initial, "")


def entity_number(qid: Column) -> Column:
    """``Q312`` as 312; anything else is null."""
    return F.when(F.rlike(qid, F.lit("^Q[0-9]+$")), F.substring(qid, 2, 20).cast("long"))


def uri_tail(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def zero_filled(number: Column, width: int = 10) -> Column:
    """Zeros before ``number`` up to ``width``; longer numbers are not cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def without_zeros(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), "^0+", "")


def like_score(name: Column, query: Column) -> Column:
    """1.0 for equality, 0.9 for a prefix, else 0.7."""
    x, q = F.lower(name), F.lower(query)
    return F.when(x == q, 1.0).when(F.startswith(x, q), 0.9).otherwise(0.7)


def search_terms(query: Column, most: int = 3) -> Column:
    """The longest words, at most three; words under three characters only if there is just one word."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) > 0)
    used = F.when(F.size(words) > 1, F.filter(words, lambda w: F.length(w) >= 3)).otherwise(words)
    ranked = F.array_sort(F.transform(used, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, most)


# How a person of each type is described.
PREPOSITIONS = {"executive": "of", "politician": "of", "government": "at", "military": "of", "legal": "at", "journalist": "at", "professional": "at", "academic": "at"}
TYPE_LABELS = {
    "executive": "executive", "politician": "politician", "government": "government official", "military": "military officer",
    "legal": "legal professional", "journalist": "journalist", "professional": "professional", "academic": "academic",
    "artist": "artist", "media": "media personality", "athlete": "athlete", "activist": "activist",
}


def with_article(noun: Column) -> Column:
    return F.concat(F.when(F.rlike(noun, F.lit("^[aeiouAEIOU]")), "an ").otherwise("a "), noun)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def describe_person(name: Column, person_type: Column, role: Column, org: Column, labels_without_role: bool = True) -> Column:
    """The sentence that a person is embedded by: ``name, a role of org`` or ``name, an artist``.

    Types that an organisation defines use role and organisation, the others their label.
    Without role and organisation the query form falls back to the label, the record form
    (``labels_without_role=False``) to the name.
    """
    kind, role, org = F.coalesce(person_type, F.lit("")), F.nullif(role, F.lit("")), F.nullif(org, F.lit(""))
    preposition = F.coalesce(_lookup(PREPOSITIONS, kind), F.lit("at"))
    known = (
        F.when(role.isNotNull() & org.isNotNull(), F.concat(name, F.lit(", "), with_article(role), F.lit(" "), preposition, F.lit(" "), org))
        .when(role.isNotNull(), F.concat(name, F.lit(", "), with_article(role)))
        .when(org.isNotNull(), F.concat_ws(" ", name, preposition, org))
    )
    label = F.concat(name, F.lit(", "), with_article(_lookup(TYPE_LABELS, kind)))
    defined, has_label = kind.isin(*PREPOSITIONS), kind.isin(*TYPE_LABELS)
    fallback = F.when(has_label, label) if labels_without_role else F.lit(None).cast("string")
    return F.when(defined, F.coalesce(known, fallback, name)).when(has_label, label).otherwise(F.coalesce(known, name))


# The prefix of each source's ids in resolved references.
ID_PREFIXES = {"gleif": "LEI", "sec_edgar": "SEC-CIK", "companies_house": "UK-CH", "wikidata": "WIKIDATA", "wikipedia": "WIKIDATA"}


def resolved_id(source: Column, source_id: Column) -> Column:
    return F.concat_ws(":", F.coalesce(_lookup(ID_PREFIXES, source), F.upper(source)), source_id)


def canonical_id(source: Column, source_id: Column, name: Column | None = None) -> Column:
    return F.concat_ws(":", source, F.coalesce(F.nullif(source_id, F.lit("")), name) if name is not None else source_id)


def confidence(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts of a query, nulls as empty text."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# What a company's kind starts with, and the type it has; the first that fits decides, without any it is a business.
UK_COMPANY_TYPES = (
    ("charitable incorporated organisation", "nonprofit"),
    ("scottish charitable incorporated organisation", "nonprofit"),
    ("community interest company", "nonprofit"),
    ("pri/ltd by guar", "nonprofit"),
    ("pri/lbg/nsc", "nonprofit"),
    ("registered society", "nonprofit"),
    ("private limited company", "business"),
    ("public limited company", "business"),
    ("private unlimited company", "business"),
    ("limited liability partnership", "business"),
    ("overseas entity", "business"),
    ("old public company", "business"),
    ("royal charter", "business"),
    ("other company type", "unknown"),
)
# Parts of an officer's role, and the type it has; the first line with a part that occurs decides, without any it is an executive.
OFFICER_ROLES = (
    ("executive", ("director", "ceo", "cfo", "cto", "coo", "chief", "managing", "president", "chairman")),
    ("legal", ("secretary", "solicitor", "lawyer", "legal")),
    ("professional", ("accountant", "engineer", "architect", "doctor", "consultant")),
)


def uk_company_type(kind: Column) -> Column:
    text = F.trim(F.lower(F.coalesce(kind, F.lit(""))))
    return F.coalesce(*[F.when(F.startswith(text, F.lit(start)), F.lit(name)) for start, name in UK_COMPANY_TYPES], F.lit("business"))


def officer_type(occupation: Column) -> Column:
    text = F.lower(F.coalesce(occupation, F.lit("")))
    return F.coalesce(*[F.when(F.rlike(text, F.lit(_any(parts))), F.lit(name)) for name, parts in OFFICER_ROLES], F.lit("executive"))


def insider_role(is_director: Column, is_officer: Column, officer_title: Column, is_ten_percent: Column) -> Column:
    """Role text of an insider's filing: director and title joined, or officer, investor, insider."""
    title = F.nullif(F.trim(officer_title), F.lit(""))
    officer = F.when(is_officer, F.coalesce(title, F.lit("Officer")))
    joined = F.concat_ws(", ", F.when(is_director, "Director"), officer)
    return F.when(joined != "", joined).when(is_ten_percent, "Investor").otherwise("Insider")


def accession_number(path: Column) -> Column:
    return F.regexp_extract(path, r"/(\d+-\d+-\d+)\.txt$", 1)
