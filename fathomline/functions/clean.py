"""Cleaning of scraped values as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_to_null(c) -> Column:
    """Null for what stands for nothing: empty, None, nan."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~F.lower(c).isin("", "none", "nan"), c)


def financial_number(c) -> Column:
    """The first number of a text; a leading ``(`` or ``-`` makes it negative; 0.0 where there is none."""
    v = F.trim(text(c))
    number = F.regexp_replace(F.regexp_extract(v, r"([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)", 1), ",", "").try_cast("double")
    sign = F.when(v.startswith("(") | v.startswith("-"), -1.0).otherwise(1.0)
    return F.coalesce(sign * number, F.lit(0.0))


def table_number(c, ratio: bool = False) -> Column:
    """A table cell's number without ``$ % ,`` and spaces; in parentheses it is negative; 0.0 where there is none."""
    v = F.trim(text(c))
    negative = v.startswith("(") & F.contains(v, F.lit(")"))
    bare = F.regexp_replace(v, r"[$%,\s()]", F.lit(" "))
    number = F.regexp_extract(F.trim(F.regexp_replace(v, r"[$,\s()]", "")), r"^(-?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    out = F.coalesce(F.when(negative, -number).otherwise(number), F.lit(0.0))
    return F.bround(out, 2) if ratio else F.when(bare.isNotNull(), out)


def performance(c) -> Column:
    """A return in percent; ``(`` anywhere makes it negative; null for dashes and what is no number."""
    v = F.trim(text(c))
    number = F.regexp_replace(v, r"[()%$,\s]", "").try_cast("double")
    return F.when(~F.contains(v, F.lit("--")), F.when(F.contains(v, F.lit("(")), -number).otherwise(number))


# Words that names are compared without.
PROVIDER_WORDS = ("vanguard", "ishares", "blackrock", "fidelity")
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "sa", "nv", "ag", "group", "holdings", "holding", "class a", "class b", "class c")


def finance_name(c) -> Column:
    """Lower case without provider names, letters and digits only, single spaces."""
    v = F.regexp_replace(F.lower(text(c)), r"\b(" + "|".join(PROVIDER_WORDS) + r")\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(v, "[^a-z0-9]+", " "), r"\s+", " "))


def company_name(c) -> Column:
    """A company's name without the, and, and legal suffixes."""
    v = F.regexp_replace(F.lower(text(c)), r"[^a-z0-9 ]+", " ")
    v = F.regexp_replace(v, r"\b(the|and)\b", " ")
    v = F.regexp_replace(v, r"\b(" + "|".join(LEGAL_SUFFIXES) + r")\b", " ")
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def person_name(c) -> Column:
    """Single spaces, and no full stop after an initial that another word follows."""
    v = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.regexp_replace(v, r"\b([A-Z])\. ", "$1 ")


def first_name(c) -> Column:
    """The first entry of a list that is not blank, else Unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.get(F.filter(c, lambda x: F.length(F.trim(x)) > 0), F.lit(0)), F.lit("Unknown"))


DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")


def any_date(c) -> Column:
    """A date in any of the accepted forms."""
    v = F.trim(text(c))
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)).cast("date") for f in DATE_FORMATS])


def provider(registrant) -> Column:
    """The provider that a registrant's name tells."""
    v = F.lower(text(registrant))
    return reduce(lambda out, p: out.when(F.contains(v, F.lit(p[0])), p[1]), [("ishares", "BlackRock"), ("blackrock", "BlackRock"), ("fidelity", "Fidelity")], F.when(F.contains(v, F.lit("vanguard")), "Vanguard")).otherwise("Other")


def in_units(value, provider_name) -> Column:
    """Net assets in dollars: some providers report millions."""
    return F.when(provider_name.isin("Vanguard", "Fidelity"), value * 1e6).otherwise(value)


def share_class(c) -> Column:
    """The kind of share class that a label tells; the first rule that fits."""
    v = F.lower(text(c))
    rules = [("admiral", "ADMIRAL"), ("institutional plus", "INSTITUTIONAL_PLUS"), ("institutional select", "INSTITUTIONAL_SELECT"), ("institutional", "INSTITUTIONAL"), ("investor", "INVESTOR"), ("etf", "ETF")]
    out = F.when(F.contains(v, F.lit(rules[0][0])), rules[0][1])
    for word, kind in rules[1:]:
        out = out.when(F.contains(v, F.lit(word)), kind)
    return out.otherwise("OTHER")


def capped(c, n: int) -> Column:
    """A text's first ``n`` characters and how many more there are."""
    c = F.col(c) if isinstance(c, str) else c
    more = (F.length(c) - n).cast("string")
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("… ["), more, F.lit(" more chars]"))).otherwise(c)


def ratio(a, b, digits: int = 4) -> Column:
    """a / b; null if either is missing or b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bround(F.when(b != 0, a / b), digits)


def percent_of(part, whole, digits: int = 2) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def scaled(value, scale) -> Column:
    """An inline XBRL number: the value times ten to its scale, given as a number or a word."""
    words = F.create_map(*[F.lit(x) for pair in {"hundreds": 2, "thousands": 3, "millions": 6, "billions": 9}.items() for x in pair])
    power = F.coalesce(F.trim(text(scale)).try_cast("int"), words[F.lower(F.trim(text(scale)))], F.lit(0))
    return F.regexp_replace(text(value), r"[,\s]", "").try_cast("double") * F.pow(F.lit(10.0), power)


# Words that names and questions are compared without; fund, etf, index and trust tell funds apart and stay.
STOPWORDS = (
    "what", "does", "show", "tell", "give", "list", "find", "which", "have", "that", "this", "from", "with", "about", "annual", "report",
    "filing", "the", "are", "for", "and", "how", "who", "when", "say", "its", "any", "all", "also", "into", "some", "been", "were", "their",
    "will", "would", "could", "should", "more", "most", "than", "your", "make", "where", "there", "they", "them", "these", "those", "such",
    "each", "very", "just", "over", "like", "only", "here", "both", "between", "through", "during", "before", "after", "above", "below",
    "since", "while", "says", "said", "using", "used", "inc", "corp", "company", "llc", "limited", "plc", "group",
)


def plain_words(c) -> Column:
    """Lower-cased words between spaces and hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text(c), F.lit(""))), "-", " "), r"\s+"), lambda w: w != "")


def matching_text(c) -> Column:
    """A question or name without stop words, as one string."""
    return F.array_join(F.filter(plain_words(c), lambda w: ~w.isin(*STOPWORDS)), " ")


def question_words(c, least: int = 3) -> Column:
    """Words of a question that may name something: possessives and signs undone, stop words left out."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text(c), F.lit(""))), r"'s\b", ""), r"[^\w\s]", " ")
    return F.filter(F.split(F.trim(v), r"\s+"), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) >= least))


def name_words(c) -> Column:
    """Words of a name that may tell it from others: more than three letters, no stop words."""
    return F.filter(plain_words(c), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 3))


def intent(c, funds: str = r"[A-Z][A-Za-z&]+(?: [A-Z0-9][A-Za-z0-9&]*)* (?:Fund|ETF|Index)", companies: str = r"[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)* (?:Inc|Corp|Corporation|Company|Co)\b\.?") -> Column:
    """A question with its fund, company and ticker replaced by placeholders, in that order."""
    v = F.regexp_replace(text(c), funds, "[fund]")
    v = F.regexp_replace(v, companies, "[company]")
    return F.regexp_replace(v, r"\b[A-Z]{2,5}\b", "[ticker]")


def holding_id(isin="isin", cusip="cusip", *rest: str) -> Column:
    """A holding's key: its ISIN, else its CUSIP, else a digest of the rest."""
    digest = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])), 1, 16)
    return F.coalesce(blank_to_null(isin), F.concat(F.lit("cusip_"), blank_to_null(cusip)), F.concat(F.lit("gen_"), digest))


def cusip_valid(c) -> Column:
    v = F.col(c)
    return F.coalesce(v.rlike(r"^[A-Za-z0-9]{8}.$") & ~v.isin("000000000", "999999999", "N/A"), F.lit(False))


def transaction_kind(code) -> Column:
    """What a transaction code of an insider report means."""
    kinds = {"P": "Purchase", "S": "Sale", "A": "Award", "M": "Option exercise", "F": "Tax withholding", "G": "Gift", "D": "Disposition", "C": "Conversion", "X": "Exercise"}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(names[F.upper(F.col(code))], F.lit("Other"))


def _compatible(values):
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).strip())


def compatible_form(c) -> Column:
    """Compatibility form of Unicode text, trimmed; no built-in function gives it."""
    from pandas import Series

    def f(v: Series) -> Series:
        return _compatible(v)

    return F.pandas_udf(f, "string")(c)


# Categories of asset codes that are bonds and equities.
BOND_CATEGORY, EQUITY_CATEGORY = "Bonds", "Equities"


def is_bond(category) -> Column:
    """Whether a holding's category, null for codes that are not known, is that of bonds."""
    return F.coalesce(F.col(category) == BOND_CATEGORY, F.lit(False))


def is_equity(category) -> Column:
    return F.coalesce(F.col(category) == EQUITY_CATEGORY, F.lit(False))


def similarity_percent(distance) -> Column:
    """Percent of cosine similarity of two unit vectors from their Euclidean distance, 0 at least."""
    d = text(distance)
    return F.greatest(F.lit(0.0), 1 - d * d / 2) * 100
