"""Sentence ends for the tokeniser (T1): which token-final periods belong to
abbreviations, found in the corpus itself without labelled text.

An abbreviation is a type that stands with a final period far more often than
chance, is short, and may have periods inside.  Each type is scored by the
log-likelihood ratio of "its periods are sentence ends like any other's" against
"it practically always has one", times factors for length, inner periods and
occurrences without a period (Kiss and Strunk, 2006).  Scores are aggregations
over token types; only the two totals of the corpus go through the driver.

Defined cases: null and empty texts have no tokens; tokens without a letter are
not types; the last token of a text always ends a sentence; an abbreviation that
also ends a sentence inside a text is taken for an abbreviation only.  U+E000 in
a text counts as white space, as it marks protected periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions import text as T

# Fixed values of the method: share of periods after abbreviations, least score.
ABBREVIATED = 0.99
LEAST_SCORE = 0.3

MARK = "\ue000"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
_LAST_PERIOD = r"\.([^\p{L}\p{N}.]*)$"


def _pieces(c: str) -> Column:
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return T._split_ws(T.plain_spaces(F.replace(text, F.lit(MARK), F.lit(" "))))


def _core(piece: Column) -> Column:
    return F.lower(F.regexp_replace(piece, _EDGES, ""))


def _type(core: Column) -> Column:
    return F.regexp_replace(core, r"\.+$", "")


def _has_period(core: Column) -> Column:
    return core.endswith(".") & ~core.endswith("..")


def score(n: Column, k: Column, word: Column, p: float) -> Column:
    """Score of a type that occurs n times, k of them with a final period, where
    a share p of all tokens have one."""
    p = min(max(p, 1e-9), 1 - 1e-9)
    without = n - k
    chance = k * F.log(F.lit(p)) + without * F.log(F.lit(1 - p))
    always = k * F.log(F.lit(ABBREVIATED)) + without * F.log(F.lit(1 - ABBREVIATED))
    size = F.length(F.regexp_replace(word, r"\.", ""))
    inner = F.length(word) - size
    found = F.round(2 * (always - chance) * F.exp(-size.cast("double")) * (inner + 1) * F.pow(size.cast("double"), -without.cast("double")), 6)
    return F.when(found == 0, F.lit(0.0)).otherwise(found)  # no negative zero


def abbreviations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n, n_period, score, is_abbreviation)`` of every type that has a
    final period somewhere; ``word`` is lower-case, without that period."""
    from quill.session import materialize
    # pieces are counted first, so the rules run once a distinct piece
    seen = (docs.select(F.explode(_pieces(text_col)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
            .select(_core(F.col("piece")).alias("core"), "_n")
            .select(_type(F.col("core")).alias("word"), "_n", F.when(_has_period(F.col("core")), F.col("_n")).otherwise(0).alias("period"))
            .where(F.col("word").rlike(r"\p{L}")))
    types = materialize(seen.groupBy("word").agg(F.sum("_n").alias("n"), F.sum("period").alias("n_period")))
    total = types.agg(F.sum("n").alias("n"), F.sum("n_period").alias("k")).first()
    share = (total["k"] or 0) / total["n"] if total["n"] else 0.0
    scored = types.where("n_period > 0").withColumn("score", score(F.col("n"), F.col("n_period"), F.col("word"), share))
    return scored.withColumn("is_abbreviation", F.col("score") >= LEAST_SCORE)


def protect(docs: DataFrame, abbreviated: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the final periods of ``abbreviated(word)`` marked in the
    text, so that no rule of the tokeniser splits them off.  Each document meets
    only its own abbreviations: distinct (doc_id, word) pairs are joined and
    come back as one short array.  Rows that repeat a ``doc_id``, or have none,
    share what is found under it."""
    dotted = lambda t: t.contains(".")  # noqa: E731 - no other piece can end in a period
    ended = F.filter(F.transform(F.filter(_pieces(text_col), dotted), _core), _has_period)
    types = F.array_distinct(F.transform(ended, _type))
    words = abbreviated.select(F.col("word").alias("_word")).distinct()
    own = (docs.select(F.col("doc_id").alias("_of"), F.explode(types).alias("_word")).distinct()
           .join(words, on="_word").groupBy("_of").agg(F.collect_list("_word").alias("_own")))

    def marked(t: Column) -> Column:
        core = _core(t)
        hit = dotted(t) & _has_period(core) & F.array_contains("_own", _type(core))
        return F.when(hit, F.regexp_replace(t, _LAST_PERIOD, MARK + "$1")).otherwise(t)

    # cut once a text: inside the lambda the text would be cut again for every piece
    pieces = F.when(F.col("_own").isNotNull(), _pieces(text_col))
    before = F.slice("_pieces", F.lit(1), F.greatest(F.size("_pieces") - 1, F.lit(0)))
    text = F.array_join(F.concat(F.transform(before, marked), F.slice("_pieces", -1, 1)), " ")
    return (docs.join(own, F.col("doc_id").eqNullSafe(F.col("_of")), "left").withColumn("_pieces", pieces)
            .withColumn(text_col, F.when(F.col("_own").isNull(), F.col(text_col)).otherwise(text)).drop("_of", "_own", "_pieces"))


def tokenize(docs: DataFrame, abbreviated: DataFrame, text_col: str = "text") -> DataFrame:
    """T1 with an abbreviation table: adds ``tokens``; an abbreviation keeps its period."""
    back = F.transform(T.tokenize(text_col), lambda t: F.translate(t, MARK, "."))
    return protect(docs, abbreviated, text_col).withColumn("tokens", back)


# ------------------------------------------------------------ DuckDB SQL twins

def _core_sql(piece: str) -> str:
    return f"lower(regexp_replace({piece}, {T._q(_EDGES)}, '', 'g'))"


def _type_sql(core: str) -> str:
    return f"regexp_replace({core}, '\\.+$', '')"


def abbreviations_sql(docs: str = "docs") -> str:
    """CTEs ending in ``ab(word, n, n_period, score, is_abbreviation)``."""
    pieces = T._split_ws_sql(f"regexp_replace(coalesce(CAST(text AS VARCHAR), ''), {T._q(T.EXOTIC_WS + '|' + MARK)}, ' ', 'g')")
    always = f"(n_period * ln({ABBREVIATED}) + (n - n_period) * ln({1 - ABBREVIATED}))"
    chance = "(n_period * ln(p) + (n - n_period) * ln(1 - p))"
    return (f"pc AS (SELECT doc_id, {pieces} AS ps FROM {docs}), "
            f"co AS (SELECT {_core_sql('piece')} AS core FROM (SELECT unnest(ps) AS piece FROM pc)), "
            f"ty AS (SELECT {_type_sql('core')} AS word, count(*) AS n, count(*) FILTER (core LIKE '%.' AND core NOT LIKE '%..') AS n_period "
            "FROM co GROUP BY 1), "
            "tl AS (SELECT * FROM ty WHERE regexp_matches(word, '\\p{L}')), "
            "tp AS (SELECT greatest(1e-9, least(1 - 1e-9, CAST(sum(n_period) AS DOUBLE) / CAST(sum(n) AS DOUBLE))) AS p FROM tl), "
            "sz AS (SELECT tl.*, tp.p, length(replace(word, '.', '')) AS size, length(word) - length(replace(word, '.', '')) AS inner_ "
            "FROM tl, tp WHERE n_period > 0), "
            f"sc AS (SELECT word, n, n_period, round(2 * ({always} - {chance}) * exp(-CAST(size AS DOUBLE)) * (inner_ + 1) "
            "* pow(CAST(size AS DOUBLE), -CAST(n - n_period AS DOUBLE)), 6) AS score FROM sz), "
            f"ab AS (SELECT word, CAST(n AS BIGINT) AS n, CAST(n_period AS BIGINT) AS n_period, CASE WHEN score = 0 THEN CAST(0 AS DOUBLE) ELSE score END AS score, score >= {LEAST_SCORE} AS is_abbreviation FROM sc)")


def protected_sql() -> str:
    """CTE ``pr(doc_id, text)`` after ``abbreviations_sql``: each piece meets the table."""
    core = _core_sql("piece")
    return ("un AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i, len(ps) AS last FROM pc), "
            f"kn AS (SELECT un.*, {core} AS core FROM un), "
            "ma AS (SELECT kn.doc_id, kn.i, CASE WHEN ab.word IS NOT NULL AND kn.i < kn.last AND core LIKE '%.' AND core NOT LIKE '%..' "
            f"THEN regexp_replace(piece, {T._q(_LAST_PERIOD)}, '{MARK}\\1') ELSE piece END AS piece "
            f"FROM kn LEFT JOIN ab ON ab.is_abbreviation AND ab.word = {_type_sql('kn.core')}), "
            "jo AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY i) AS text FROM ma GROUP BY doc_id), "
            "pr AS (SELECT pc.doc_id, coalesce(jo.text, '') AS text FROM pc LEFT JOIN jo ON pc.doc_id = jo.doc_id)")
