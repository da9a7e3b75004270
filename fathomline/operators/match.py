"""Fuzzy joins: an index of three-letter pieces finds the pairs, so that costly scores are taken of few."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fathomline.functions import clean, fuzzy
from fathomline.operators import naming, near

#: Part of the shorter text's pieces that two texts must share to be compared.
SHARE = 0.4


def pieces(c, n: int = 3) -> Column:
    """The distinct runs of ``n`` letters of a text that begins and ends with a space."""
    v = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v) - n + 1)), lambda i: F.substring(v, i, n)))


def candidates(left: DataFrame, right: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs (x, y) of the distinct texts x of ``left`` and y of ``right`` that share at least ``share`` of the pieces of
    the one with fewer; all such pairs, whatever the order of their words and wherever they differ.

    A text with fewer pieces meets the other by one of its rarest pieces, as many as make sure of it, so pieces that most
    texts have bring no pairs together unless a text has no others.
    """
    a = left.select("x").filter("x <> ''").distinct().withColumn("px", pieces(F.col("x")))
    b = right.select("y").filter("y <> ''").distinct().withColumn("py", pieces(F.col("y")))
    both = a.select(F.explode("px").alias("g")).unionByName(b.select(F.explode("py").alias("g")))
    seen = both.groupBy("g").agg(F.count("*").alias("often"))

    def placed(df: DataFrame, text: str, parts: str) -> DataFrame:
        rows = df.select(text, F.size(parts).alias(f"n{text}"), F.explode(parts).alias("g")).join(seen, "g")
        return rows.withColumn(f"at{text}", F.row_number().over(Window.partitionBy(text).orderBy("often", "g"))).drop("often")

    first = lambda text: F.col(f"at{text}") <= F.col(f"n{text}") - F.ceil(F.col(f"n{text}") * share) + 1
    x, y = placed(a, "x", "px"), placed(b, "y", "py")
    short = x.filter(first("x")).join(y, "g").filter("nx <= ny")
    long = y.filter(first("y")).join(x, "g").filter("ny < nx")
    met = short.select("x", "y").unionByName(long.select("x", "y")).distinct().join(a, "x").join(b, "y")
    enough = F.size(F.array_intersect("px", "py")) >= F.ceil(F.least(F.size("px"), F.size("py")) * share)
    return met.filter(enough).select("x", "y")


def top_matches(queries: DataFrame, names: DataFrame, threshold: float, keep: int, band: float = 5.0, scorer=fuzzy.weighted_ratio, share: float = SHARE) -> DataFrame:
    """For each query (query_id, query) the names (name_id, name) within ``band`` of its best score, if that reaches
    ``threshold``; ``keep`` at most. Texts are compared without case, distinct pairs once."""
    q, n = queries.withColumn("x", F.lower("query")), names.withColumn("y", F.lower("name"))
    scored = candidates(q, n, share).withColumn("score", scorer(F.col("x"), F.col("y")))
    return best_of(q.join(scored, "x").join(n, "y").drop("x", "y"), threshold, keep, band)


def best_of(scored: DataFrame, threshold, keep, band: float, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Of each query's scored names those within ``band`` of the best, if that reaches ``threshold``; these and ``keep``
    may be columns."""
    by = Window.partitionBy(*by)
    ranked = scored.withColumn("top", F.max("score").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "name_id")))
    return ranked.filter((F.col("top") >= threshold) & (F.col("score") >= F.col("top") - band) & (F.col("rank") <= keep)).drop("top")


def sharing_words(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of texts of words (x, wx) and (y, wy) with a word in common whose word-set ratio (0 to 1) may reach
    ``threshold``, judged by lengths: of the shorter text, or of what they share."""
    size = lambda c: F.length(F.array_join(c, " "))
    both, n, m = size(F.array_intersect("wx", "wy")), size("wx"), size("wy")
    reach = lambda part, whole: 2 * part >= threshold * (part + whole)
    met = left.withColumn("w", F.explode("wx")).join(right.withColumn("w", F.explode("wy")), "w")
    return met.filter(reach(F.least(n, m), F.greatest(n, m)) | reach(both, n) | reach(both, m)).select("x", "y").distinct()


def cascade(left: DataFrame, right: DataFrame, threshold: float = 0.74, block: int = 6) -> DataFrame:
    """Matches (left_id, right_id, score, stage) of names, each stage for what those before it left.

    Stage ``exact``: equal normalised names. Stage ``prefix``: best sequence ratio among names with the same ``block``
    first letters. Stage ``wide``: best word-set ratio among all names. Ties go to the smaller right_id. Names that are
    empty when normalised match nothing. A pair is scored if the ratio of its longest common subsequence, which bounds
    that of its blocks, reaches the threshold (``near.pairs``), for the wide stage with words in order, or if it has a
    word in common and lengths that allow the threshold; no other pair can reach it.
    """
    a = left.select("left_id", clean.company_name("name").alias("x")).filter("x <> ''")
    b = right.select("right_id", clean.company_name("name").alias("y")).filter("y <> ''").groupBy("y").agg(F.min("right_id").alias("right_id"))
    equal = a.join(b, F.col("x") == F.col("y"), "left").select("left_id", "x", F.col("right_id").alias("equal_id"))
    sets = lambda df, c: df.select(c, F.array_sort(F.array_distinct(F.split(c, " "))).alias(f"w{c}"))
    rest, names = sets(equal.filter("equal_id IS NULL").select("x").distinct(), "x"), sets(b, "y")
    begun = near.pairs(rest, names, threshold, same=block).withColumn("prefix", fuzzy.sequence_ratio("x", "y"))
    ordered = lambda df, c: df.select(F.col(c).alias(f"of{c}"), F.array_join(f"w{c}", " ").alias(c))
    p, q = ordered(rest, "x"), ordered(names, "y")
    apart = near.pairs(p, q, threshold).join(p, "x").join(q, "y").select(F.col("ofx").alias("x"), F.col("ofy").alias("y"))
    wide = apart.unionByName(sharing_words(rest, names, threshold)).distinct().withColumn("wide", fuzzy.token_set_ratio("x", "y") / 100)
    scored = begun.unionByName(wide, allowMissingColumns=True).join(b, "y")
    best = lambda c: F.max(F.when(F.col(c) >= threshold, F.struct(F.col(c).alias("score"), (-F.col("right_id")).alias("r")))).alias(c)
    one = equal.join(scored.groupBy("x").agg(best("prefix"), best("wide")), "x", "left")
    is_ = lambda c, name: F.when(F.col(c).isNotNull(), F.struct((-F.col(f"{c}.r")).alias("right_id"), F.col(f"{c}.score").alias("score"), F.lit(name).alias("stage")))
    exact = F.when(F.col("equal_id").isNotNull(), F.struct(F.col("equal_id").alias("right_id"), F.lit(1.0).alias("score"), F.lit("exact").alias("stage")))
    return one.select("left_id", F.coalesce(exact, is_("prefix", "prefix"), is_("wide", "wide")).alias("m")).filter("m IS NOT NULL").select("left_id", "m.*")


def equal_then_contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches (left_id, right_id, stage) of normalised names that are equal, else where one holds the other's words.

    The second stage joins on a shared word before it looks for containment.
    """
    a = left.withColumn("norm", clean.finance_name("name")).filter("norm <> ''")
    b = right.withColumn("norm", clean.finance_name("name")).filter("norm <> ''")
    equal = a.join(b, "norm").groupBy("left_id").agg(F.min("right_id").alias("right_id")).withColumn("stage", F.lit("equal"))
    rest = a.join(equal, "left_id", "left_anti").withColumn("word", F.explode(F.array_distinct(F.split("norm", " "))))
    words = b.select("right_id", F.col("norm").alias("other")).withColumn("word", F.explode(F.array_distinct(F.split("other", " "))))
    held = rest.join(words, "word").filter(F.contains("norm", F.col("other")) | F.contains("other", F.col("norm")))
    held = held.groupBy("left_id").agg(F.min("right_id").alias("right_id")).withColumn("stage", F.lit("contained"))
    return equal.unionByName(held)


def first_equal(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Left rows with the first right row whose ``on`` is equal whatever the case."""
    first = right.withColumn("__k", F.lower(on)).withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(order))).filter("__n = 1").drop("__n", on)
    return left.withColumn("__k", F.lower(on)).join(first, "__k", "left").drop("__k")


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (name, part) of the distinct texts whose lower-cased, trimmed part lies in the lower-cased name.

    A part meets the names by its rarest piece of three letters, or by itself if it is shorter.
    """
    whole, low = names.select("name").distinct(), F.trim(F.lower("part"))
    small = parts.select("part", low.alias("low")).filter("low <> ''").distinct()
    runs = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(*[runs(F.lower("name"), n) for n in (1, 2, 3)]))
    index = whole.select("name", F.explode(every).alias("g"))
    often = index.groupBy("g").agg(F.count("*").alias("often"))
    keys = small.select("part", "low", F.explode(F.when(F.length("low") < 3, F.array("low")).otherwise(runs(F.col("low"), 3))).alias("g"))
    rarest = keys.join(often, "g", "left").groupBy("part", "low").agg(F.min_by("g", F.struct(F.coalesce("often", F.lit(0)), "g")).alias("g"))
    return rarest.join(index, "g").filter(F.contains(F.lower("name"), F.col("low"))).select("name", "part")


def with_series(funds: DataFrame, reports: DataFrame) -> DataFrame:
    """``funds`` (name) with the series_id of a report (fund_name, series_id, row) whose name lies in theirs; of several
    the last by ``row``. Reports without a name or series take no part."""
    sound = reports.filter("fund_name <> '' AND series_id <> ''")
    met = containing(funds.select("name"), sound.select(F.col("fund_name").alias("part"))).join(sound, F.col("part") == F.col("fund_name"))
    last = met.groupBy("name").agg(F.max_by("series_id", "row").alias("series_id"))
    return funds.join(last, "name", "left")


# Texts that stand for no share class.
NO_CLASS = ("", "none", "nan", "<na>", "other", "unknown")


def share_class_rows(rows: DataFrame, key: str, wanted: str, have: str) -> DataFrame:
    """Of each key's rows those whose class (``have``) fits the one ``wanted``, with how they were found (``fit``).

    1: one text holds the other, both name none, or both speak of exchange-traded shares; if none does, 2: rows without
    a class; if there are none, 3: all rows.
    """
    norm = lambda c: F.coalesce(clean.finance_name(c), F.lit(""))
    w, h = norm(wanted), norm(have)
    none = lambda c: c.isin(*NO_CLASS)
    etf = F.contains(w, F.lit("etf")) & (F.contains(h, F.lit("etf")) | F.contains(h, F.lit("shares")))
    fits = F.when(none(w), none(h)).otherwise(F.contains(h, w) | F.contains(w, h) | etf)
    empty = F.lower(F.trim(F.coalesce(F.col(have), F.lit("")))).isin(*NO_CLASS)
    ranked = rows.withColumn("fit", F.when(fits, 1).when(empty, 2).otherwise(3))
    return ranked.withColumn("__b", F.min("fit").over(Window.partitionBy(key))).filter("fit = __b").drop("__b")


def name_lookup(names: DataFrame, text: str, most: int = 2) -> DataFrame:
    """Names (name_id, name) with a word within ``most`` edits of a word of ``text``; ``distance`` is the least.

    One pass over the names; the words of the search are few.
    """
    asked = [w for w in text.lower().replace("~", " ").split() if w]
    words = F.split(F.lower("name"), r"[^\p{L}\p{N}]+")
    edits = [F.array_min(F.transform(words, lambda x: F.levenshtein(x, F.lit(w)))) for w in asked]  # noqa: B023
    least = F.least(*edits) if len(edits) > 1 else edits[0] if edits else F.lit(None).cast("int")
    return names.select("name_id", "name", least.alias("distance")).filter(F.col("distance") <= most)


# Words that tell which kinds of names a question may hold.
KEYWORDS = {
    "provider": ("provider", "manage", "manages", "managed"),
    "trust": ("trust", "vanguard index funds"),
    "fund": ("fund", "etf", "index", "portfolio", "holdings", "strategy", "prospectus", "stock", "market", "ratio", "performance", "return", "allocation", "equity", "bond", "sector", "objective", "risk"),
    "company": ("company", "10-k", "10k", "annual", "filing", "revenue", "earnings", "ceo", "executive", "insider", "acquisition", "merger", "fiscal", "inc", "corp", "business", "report", "financials", "financial", "highlights", "quarterly", "balance sheet", "income statement", "portfolio"),
}
# Words that ask about many funds at once.
AGGREGATE = ("highest", "lowest", "best", "worst", "most", "least", "greatest", "average", "across all", "among all", "every fund", "all funds", "compare all", "rank all", "top fund", "bottom fund")
# Scores from which a match holds, and how many are kept.
CUTOFFS = {"provider": 60.0, "trust": 75.0, "fund": 82.0, "aggregate": 87.0, "company": 70.0}
KEPT = {"fund": 5, "company": 3}
BAND, TOKEN_FROM, PARTIAL_GAIN = 5.0, 80.0, 1.1
#: Questions and names that meet in one task.
ASKED, NAMES = 2000, 100_000


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def is_aggregate(c="query") -> Column:
    """Whether a question is about many funds; one with a word of two to five capitals is not, nor is a null.

    Words end at what is not an ASCII letter, digit or underscore, whatever ``\\b`` means to the Java version.
    """
    ticker = F.col(c).rlike(r"(?<![0-9A-Za-z_])[A-Z]{2,5}(?![0-9A-Za-z_])")
    return F.coalesce(~ticker & any_of(F.lower(c), AGGREGATE), F.lit(False))


def capital_words(c="query") -> Column:
    """Words of two characters or more, without signs and possessive endings, that are written in capitals."""
    words = F.transform(F.split(F.trim(F.col(c)), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, "'[Ss]$", ""), "[^A-Za-z0-9]", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & (w == F.upper(w))))


def named(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, kind, name_id, name, score) of the names (kind, name_id, name) that a question (query_id, query, kind,
    cutoff, keep) may mean, its ``keep`` best within BAND of the best one; more where names are many.

    The score is the best of word-set ratio, partial ratio with a gain, and the ratio of a word of the query with one of
    the name, from TOKEN_FROM, weighed by the words in common. Whole texts are compared where they share SHARE of their
    pieces, words all. Parts of both sides meet, each in one task, which need not score every name (``naming``).
    """
    n, m = max(1, -(-queries.count() // ASKED)), max(1, -(-names.count() // NAMES))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    text = lambda c: clean.matching_text(c).alias("text")
    q = queries.filter("query_id IS NOT NULL").select("query_id", "kind", text("query"), F.array_distinct(clean.question_words("query")).alias("tokens"), F.col("cutoff").cast("double").alias("cutoff"), F.col("keep").cast("int").alias("keep"), part("query_id", n).alias("i"), every(m).alias("j"))
    k = names.filter("name_id IS NOT NULL").select("kind", "name_id", "name", text("name"), F.array_distinct(clean.name_words("name")).alias("tokens"), every(n).alias("i"), part("name_id", m).alias("j"))

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        return naming.best_names(asked, there, TOKEN_FROM, BAND, PARTIAL_GAIN, SHARE)

    kind = StructType([q.schema["query_id"], q.schema["kind"], k.schema["name_id"], k.schema["name"], StructField("score", DoubleType())])
    sides = (df.repartition(2 * n * m, "kind", "i", "j").groupBy("kind", "i", "j") for df in (q, k))
    return next(sides).cogroup(next(sides)).applyInArrow(meet, kind)


def resolve(queries: DataFrame, funds: DataFrame, companies: DataFrame, providers: DataFrame, trusts: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, name_id, name, score): what a question names.

    A ticker in capitals scores 100 and leaves funds out. Which kinds of names are looked for, KEYWORDS tell; from which
    score they hold, CUTOFFS; of providers and trusts the best one is kept, of funds and companies those within BAND of
    the best. ``funds`` and ``companies`` have name_id, name, ticker; ``providers`` and ``trusts`` name_id, name.
    """
    kinds = lambda **tables: functools.reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "name_id", "name", *(["ticker"] if "ticker" in df.columns else [])) for k, df in tables.items()])
    low = F.lower("query")
    every, houses = kinds(fund=funds, company=companies), kinds(provider=providers, **({} if trusts is None else {"trust": trusts}))
    flagged = queries.select("query_id", "query", is_aggregate().alias("many"), *[any_of(low, words).alias(f"asks_{k}") for k, words in KEYWORDS.items()])
    tickers = queries.withColumn("ticker", F.explode(capital_words()))
    exact = tickers.join(every, "ticker").select("query_id", "kind", "name_id", "name", F.lit(100.0).alias("score")).distinct()
    flagged = flagged.join(exact.select("query_id").distinct().withColumn("has_ticker", F.lit(True)), "query_id", "left")
    asked = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"asks_{k}")) for k in KEYWORDS]) & ((F.col("kind") != "fund") | F.col("has_ticker").isNull())
    cutoff = F.coalesce(*[F.when(F.col("kind") == k, F.when(F.col("many"), CUTOFFS["aggregate"]).otherwise(CUTOFFS[k]) if k == "fund" else CUTOFFS[k]) for k in KEYWORDS])
    keep = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in KEPT.items()], F.lit(1))

    pick = lambda scored: best_of(scored.join(flagged.drop("query"), "query_id").filter(asked), cutoff, keep, BAND, ("query_id", "kind")).select(*exact.columns)
    wanted = flagged.withColumn("kind", F.explode(F.array(F.lit("fund"), F.lit("company")))).filter(asked)
    some = wanted.select("query_id", "query", "kind", cutoff.alias("cutoff"), keep.alias("keep"))
    held = flagged.filter("asks_provider OR asks_trust").select("query_id", low.alias("x"))
    n = houses.withColumn("y", F.lower("name"))
    score = F.when(F.col("kind") == "trust", fuzzy.partial_ratio("x", "y")).otherwise(fuzzy.weighted_ratio("x", "y"))
    scored = held.join(candidates(held, n), "x").join(n, "y").withColumn("score", score)
    out = exact.unionByName(pick(named(some, every))).unionByName(pick(scored.select(*exact.columns)))
    return out.groupBy("query_id", "kind", "name_id", "name").agg(F.max("score").alias("score"))
