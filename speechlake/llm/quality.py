"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpointed, shared_folder

MIN_WORDS = 50
#: Names of the rules, in the order of their votes.
RULES = ("symbols", "dup_lines", "upper", "line_ends", "repeats", "bangs", "word_length", "symbol_words", "symbol_runs")
ROUNDS = 20
#: A word with a symbol in it, and symbols that stand three together or begin a word.
SYMBOL_WORD = r"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*"
SYMBOL_RUN = r"[#*$%&|<>]{3,}|(^|[\x20\x09-\x0D])[#*$%&|<>]+"
#: Where the estimates start, which says what a vote means: accuracy on good and on bad documents, share of good ones.
START_GOOD, START_BAD, START_SHARE = 0.95, 0.5, 0.9
#: Documents that the start counts for.
WEIGHT = 50.0


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared by 64-bit hashes."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")
        same = let(ordered, lambda s: F.flatten(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))))
        starts = F.sort_array(F.array_distinct(same))
        steps = let(starts, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return let(words, of).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    Null text counts as empty. All come from the whole text in one pass without a shuffle. Columns of docs that
    have these names are replaced (put rows of unknown columns into a struct, as `good_documents` does).
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def without(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    made = docs.drop("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines").withColumns({"_w": words, "_l": lines, "n_symbols": without(r"[#*$%&|<>]"), "n_upper": without("[A-ZÀ-ÖØ-Þ]"), "n_bangs": without("!!"), "n_ended": F.regexp_count(text, F.lit(r"[.!?][ \t\r]*(\n|\z)")).cast("long"), "n_symbol_words": F.regexp_count(text, F.lit(SYMBOL_WORD)).cast("long"), "n_symbol_runs": F.regexp_count(text, F.lit(SYMBOL_RUN)).cast("long")})
    return made.select(*made.columns, "_w.*", "_l.*").drop("_w", "_l")


def votes() -> Column:
    """One vote per rule: 1 good, 0 bad, -1 abstain."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    return F.array(
        vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 <= n),
        vote(F.col("n_dup_lines") * 10 > lines * 3, F.col("n_dup_lines") * 10 <= lines),
        vote(F.col("n_upper") * 10 > chars * 3, F.col("n_upper") * 10 <= chars),
        vote(F.col("n_ended") * 10 < lines * 3, F.col("n_ended") * 10 >= lines * 8),
        vote(F.col("n_repeat_words") * 5 > n, F.col("n_repeat_words") * 20 <= n),
        vote(F.col("n_bangs") * 5 > n, F.col("n_bangs") * 25 <= n),
        vote((chars > n * 12) | (chars * 2 < n * 5), (chars <= n * 9) & (chars * 2 >= n * 7)),
        vote(F.col("n_symbol_words") * 10 > n, F.col("n_symbol_words") * 50 <= n),
        vote(F.col("n_symbol_runs") * 10 > n, F.col("n_symbol_runs") * 50 <= n),
    )


def posteriors(patterns: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """votes, n -> votes, p_good: the probability that a document with these votes is good.

    One row per pattern of votes (3 to the number of rules at most, whatever the number of documents). Each round takes the
    patterns' posterior from the rules' log odds and then the rules' accuracies on good and on bad documents
    and the share of good ones from the posteriors. Starting values count as WEIGHT documents, so that rules
    keep their meaning on tables where nothing or everything is bad.
    """
    rules = range(n_rules)
    state = lambda share, good, bad: F.struct(
        (F.log(share) - F.log(1 - share)).alias("base"),
        F.array(*(F.log(g) - F.log(1 - b) for g, b in zip(good, bad))).alias("up"),
        F.array(*(F.log(1 - g) - F.log(b) for g, b in zip(good, bad))).alias("down"),
    )
    first = state(F.lit(START_SHARE), [F.lit(START_GOOD)] * n_rules, [F.lit(START_BAD)] * n_rules)

    def p_good(s: Column, v: Column) -> Column:
        odds = s["base"]
        for j in rules:
            vote = F.get(v, F.lit(j))
            odds = odds + F.when(vote == 1, F.get(s["up"], F.lit(j))).when(vote == 0, F.get(s["down"], F.lit(j))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def step(s: Column, _: Column) -> Column:
        weighed = F.transform("patterns", lambda x: F.struct(x["votes"].alias("votes"), (x["n"] * p_good(s, x["votes"])).alias("g"), (x["n"] * (1 - p_good(s, x["votes"]))).alias("b")))

        def update(rows: Column) -> Column:
            def total(f: Callable[[Column], Column]) -> Column:
                return F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x))

            def of(j: int, part: str, vote: int, start: float) -> Column:
                hit = total(lambda x: F.when(F.get(x["votes"], F.lit(j)) == vote, x[part]).otherwise(0.0))
                cast = total(lambda x: F.when(F.get(x["votes"], F.lit(j)) >= 0, x[part]).otherwise(0.0))
                return (hit + start * WEIGHT) / (cast + WEIGHT)

            g, b = total(lambda x: x["g"]), total(lambda x: x["b"])
            made = F.struct(((g + START_SHARE * WEIGHT) / (g + b + WEIGHT)).alias("share"), F.array(*(of(j, "g", 1, START_GOOD) for j in rules)).alias("good"), F.array(*(of(j, "b", 0, START_BAD) for j in rules)).alias("bad"))
            return let(made, lambda m: state(m["share"], [F.get(m["good"], F.lit(j)) for j in rules], [F.get(m["bad"], F.lit(j)) for j in rules]))

        return let(weighed, update)

    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    fitted = one.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step))
    each = fitted.select("model", F.explode("patterns").alias("x"))
    return each.select(F.col("x.votes").alias("votes"), p_good(F.col("model"), F.col("x.votes")).alias("p_good"))


def judged(rows: DataFrame, threshold: float = 0.5, min_words: int = MIN_WORDS) -> DataFrame:
    """rows of features() with votes, p_good, base_failed and kept; rows is read twice.

    base_failed: fewer than min_words words, or more than half of them in repeated 3-word windows. The other
    documents are kept where p_good reaches the threshold. Estimates come from the votes of all documents that
    the base does not reject. Three rules look at symbols, in three ways: their votes hang together, so they
    count for more than independent ones would, but with one of them alone the two kinds of documents cannot be
    told apart, as no other rule tells most bad documents from good ones.
    Null and empty texts have no words and fail; repeated rows count once each; an empty table stays empty.
    """
    n = F.col("n_words")
    made = rows.withColumns({"votes": votes(), "base_failed": (n < min_words) | (F.col("n_repeat_words") * 100 > n * 50)})
    passed = F.count_if(~F.col("base_failed")).alias("n")
    fitted = checkpointed(posteriors(made.groupBy("votes").agg(passed)))  # 3 ** 9 rows at most
    return made.join(F.broadcast(fitted), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def good_documents(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """The rows of docs that are kept, with their own columns only, whatever their names.

    A short text is judged by its votes; null and empty texts, and those without a word, go. Features are written
    to the shared folder with their rows, so that texts are scanned once. An empty table stays empty.
    """
    folder = shared_folder(docs.sparkSession, "features")
    features(docs.select(F.struct("*").alias("_doc"), "text")).drop("text").write.option("compression", "zstd").parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    return judged(rows, min_words=min_words).where("kept").select("_doc.*")


def op10_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null texts have no words and fail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = checkpointed(features(docs).drop("text"))
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _em_sql() -> str:
    rules = range(len(RULES))
    rows = ", ".join(f"({j})" for j in rules)
    out = f"""e0 AS MATERIALIZED (SELECT j, {START_GOOD}::DOUBLE AS g, {START_BAD}::DOUBLE AS b, {START_SHARE}::DOUBLE AS s FROM (VALUES {rows}) AS v(j)),"""
    for i in range(ROUNDS + 1):
        out += f"""
p{i} AS MATERIALIZED (SELECT pat, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln(s) - ln(1 - s)) + sum(CASE v WHEN 1 THEN ln(g) - ln(1 - b) WHEN 0 THEN ln(1 - g) - ln(b) ELSE 0 END)))) AS p
  FROM cells JOIN e{i} USING (j) GROUP BY pat),"""
        if i < ROUNDS:
            out += f"""
e{i + 1} AS MATERIALIZED (SELECT j, (coalesce(sum(n * p) FILTER (v = 1), 0) + {START_GOOD} * {WEIGHT}) / (coalesce(sum(n * p) FILTER (v >= 0), 0) + {WEIGHT}) AS g,
  (coalesce(sum(n * (1 - p)) FILTER (v = 0), 0) + {START_BAD} * {WEIGHT}) / (coalesce(sum(n * (1 - p)) FILTER (v >= 0), 0) + {WEIGHT}) AS b,
  (sum(n * p) + {START_SHARE} * {WEIGHT}) / (sum(n) + {WEIGHT}) AS s
  FROM cells JOIN (SELECT pat, p FROM p{i}) USING (pat) GROUP BY j),"""
    return out


#: CTEs from a view named docs_in (doc_id, text, ...) to judged, one row per document.
QUALITY_CTES = (
    r"""numbered AS MATERIALIZED (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS r FROM docs_in),
counted AS MATERIALIZED (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!!', '')) AS n_bangs,
    len(regexp_extract_all(t, '[.!?][ \t\r]*(\n|\z)')) AS n_ended,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*')) AS n_symbol_words,
    len(regexp_extract_all(t, '[#*$%&|<>]{3,}|(^|[\x20\x09-\x0D])[#*$%&|<>]+')) AS n_symbol_runs
  FROM numbered),
places AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM counted),
windows AS (SELECT r, i, w || chr(31) || lead(w, 1) OVER o || chr(31) || lead(w, 2) OVER o AS w3 FROM places WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w3) AS c FROM windows WHERE w3 IS NOT NULL) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
feats AS MATERIALIZED (
  SELECT r, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, n_upper, n_bangs, n_ended, n_symbol_words, n_symbol_runs
  FROM counted LEFT JOIN repeats USING (r)),
voted AS MATERIALIZED (
  SELECT *, [CASE WHEN n_symbols * 10 > n_words THEN 0 WHEN n_symbols * 50 <= n_words THEN 1 ELSE -1 END,
    CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN 0 WHEN n_dup_lines * 10 <= n_lines THEN 1 ELSE -1 END,
    CASE WHEN n_upper * 10 > word_chars * 3 THEN 0 WHEN n_upper * 10 <= word_chars THEN 1 ELSE -1 END,
    CASE WHEN n_ended * 10 < n_lines * 3 THEN 0 WHEN n_ended * 10 >= n_lines * 8 THEN 1 ELSE -1 END,
    CASE WHEN n_repeat_words * 5 > n_words THEN 0 WHEN n_repeat_words * 20 <= n_words THEN 1 ELSE -1 END,
    CASE WHEN n_bangs * 5 > n_words THEN 0 WHEN n_bangs * 25 <= n_words THEN 1 ELSE -1 END,
    CASE WHEN word_chars > n_words * 12 OR word_chars * 2 < n_words * 5 THEN 0 WHEN word_chars <= n_words * 9 AND word_chars * 2 >= n_words * 7 THEN 1 ELSE -1 END,
    CASE WHEN n_symbol_words * 10 > n_words THEN 0 WHEN n_symbol_words * 50 <= n_words THEN 1 ELSE -1 END,
    CASE WHEN n_symbol_runs * 10 > n_words THEN 0 WHEN n_symbol_runs * 50 <= n_words THEN 1 ELSE -1 END] AS pat,
    n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed
  FROM feats),
pats AS MATERIALIZED (SELECT pat, (count(*) FILTER (NOT base_failed))::DOUBLE AS n FROM voted GROUP BY pat),
cells AS MATERIALIZED (SELECT pat, n, unnest(pat) AS v, generate_subscripts(pat, 1) - 1 AS j FROM pats),
"""
    + _em_sql()
    + f"""
judged AS MATERIALIZED (
  SELECT d.*, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept
  FROM voted JOIN (SELECT pat, p FROM p{ROUNDS}) USING (pat) JOIN numbered d USING (r))"""
)

OP10_SQL = f"""WITH docs_in AS (SELECT doc_id, text FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
