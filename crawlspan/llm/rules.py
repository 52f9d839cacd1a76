"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps a failure bit for
each rule and the measurements behind it. A policy is a versioned mask over
those bits: applying or comparing policies never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measurements by name, in the order of the ledger's columns.
MEASURES = ("n_chars", "n_words", "symbol_ratio", "upper_ratio", "bang_ratio", "distinct_ratio", "adjacent_ratio", "line_dup_ratio", "pipe_ratio", "mean_word")


@dataclass(frozen=True)
class Rule:
    """A document fails where `sql` (over the measurements; Spark and DuckDB read it alike) is true."""

    bit: int
    name: str
    sql: str


RULES = (
    Rule(0, "empty", "n_words = 0"),
    Rule(1, "too_short", "n_words > 0 AND n_words < 5"),
    Rule(2, "too_long", "n_words > 100000"),
    Rule(3, "symbols", "symbol_ratio > 0.05"),
    Rule(4, "capitals", "n_chars >= 40 AND upper_ratio > 0.4"),
    Rule(5, "exclamations", "bang_ratio > 0.1"),
    Rule(6, "few_distinct_words", "n_words >= 50 AND distinct_ratio < 0.35"),
    Rule(7, "stuttering", "n_words >= 20 AND adjacent_ratio > 0.3"),
    Rule(8, "repeated_lines", "line_dup_ratio > 0.4"),
    Rule(9, "table_debris", "n_words >= 10 AND pipe_ratio > 0.2"),
    Rule(10, "word_length", "n_words >= 50 AND (mean_word < 2 OR mean_word > 15)"),
)


def mask(*names: str) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


#: Policy version -> mask. A published version never changes; a new one is added.
POLICIES = {
    "v1": mask("empty", "symbols", "capitals", "stuttering"),
    "v2": mask("empty", "symbols", "capitals", "exclamations", "few_distinct_words", "stuttering", "repeated_lines", "table_debris", "word_length"),
    "strict": mask(*(r.name for r in RULES)),
}

#: Words in a window of `window_ratio`, and what a text's distinct words grow with beyond it.
WINDOW = 500
#: Measurements, rules and policies published since, in a ledger of their own: what `ledger` returns never changes either.
LATER_MEASURES = ("window_ratio", "full_line_dup_ratio")
LATER_RULES = (
    Rule(11, "little_variety", f"n_words >= 50 AND (window_ratio < 0.35 OR distinct_ratio * sqrt(greatest(n_words, {WINDOW}) / {WINDOW}) < 0.35)"),
    Rule(12, "repeated_full_lines", "full_line_dup_ratio > 0.4"),
)
_V3 = ("empty", "symbols", "capitals", "exclamations", "stuttering", "repeated_lines", "table_debris", "word_length")
LATER_POLICIES = {
    "v3": mask(*_V3) | 1 << 11,
    "v4": mask(*_V3) & ~mask("repeated_lines") | 1 << 11 | 1 << 12,
}

#: The version that the pipeline applies.
CURRENT = "v4"

_SPACE = "[ \\t\\n\\r]+"


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, the measurements, and `fail_bits` (BIGINT; bit i set where rule i fails).

    One narrow pass without a shuffle. Each document keeps its own row, repeated
    ids and repeated rows included; a NULL text counts as an empty one, which
    fails rule `empty` and has 0 for every ratio; a NULL id stays NULL; other
    columns, whatever they are called, are ignored; an empty table gives an
    empty ledger. Texts are measured whole.
    """
    return _ledger(docs, text, key, RULES, MEASURES)


def later_ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`ledger` with LATER_MEASURES and the bits of LATER_RULES as well.

    window_ratio is the number of distinct words in each WINDOW words, summed
    over the whole text, by all its words: unlike distinct_ratio it doesn't fall
    with length. A passage longer than a window that comes again and again is
    told by the distinct words of the whole text, which in prose grow with the
    square root of its length at least. full_line_dup_ratio leaves out lines
    that are empty or hold only spaces, tabs and carriage returns.
    """
    return _ledger(docs, text, key, RULES + LATER_RULES, MEASURES + LATER_MEASURES)


def _ledger(docs: DataFrame, text: str, key: str, rules: tuple[Rule, ...], measures: tuple[str, ...]) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    flat = docs.select(F.col(key).alias("id"), _once(t=t, w=F.trim(F.regexp_replace(t, _SPACE, " "))))
    parts = flat.select(
        "id",
        _once(
            nc=F.length("t"),
            ws=F.when(F.col("w") == "", F.array().cast("array<string>")).otherwise(F.split("w", " ")),
            ls=F.split("t", "\n"),
            **({"fl": F.filter(F.split("t", "\n"), lambda x: ~x.rlike(r"^[ \t\r]*$"))} if "full_line_dup_ratio" in measures else {}),
            symbols=F.length("t") - F.length(F.translate("t", "#$%&*", "")),
            uppers=F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")),
            bangs=F.length("t") - F.length(F.replace(F.col("t"), F.lit("!"), F.lit(""))),
            pipes=F.length("t") - F.length(F.replace(F.col("t"), F.lit("|"), F.lit(""))),
            solid=F.length(F.replace(F.col("w"), F.lit(" "), F.lit(""))),
        ),
    )
    n = F.greatest(F.size("ws"), F.lit(1))
    later = {
        "window_ratio": F.when(F.size("ws") <= WINDOW, F.size(F.array_distinct("ws"))).otherwise(F.size(F.array_distinct(F.transform("ws", lambda w, i: F.concat(F.floor(i / WINDOW).cast("string"), F.lit(" "), w))))) / n,
        "full_line_dup_ratio": (F.size("fl") - F.size(F.array_distinct("fl"))) / F.greatest(F.size("fl"), F.lit(1)),
    }
    measured = parts.select(
        "id",
        _once(
            **{m: c for m, c in later.items() if m in measures},
            n_chars=F.col("nc").cast("long"),
            n_words=F.size("ws").cast("long"),
            symbol_ratio=F.col("symbols") / F.greatest("nc", F.lit(1)),
            upper_ratio=F.col("uppers") / F.greatest("nc", F.lit(1)),
            bang_ratio=F.col("bangs") / n,
            distinct_ratio=F.size(F.array_distinct("ws")) / n,
            adjacent_ratio=F.coalesce(_adjacent("ws"), F.lit(0)) / n,
            line_dup_ratio=(F.size("ls") - F.size(F.array_distinct("ls"))) / F.size("ls"),
            pipe_ratio=F.col("pipes") / n,
            mean_word=F.col("solid") / n,
        ),
    )
    bits = None
    for r in rules:
        b = F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
        bits = b if bits is None else bits.bitwiseOR(b)
    return measured.select(F.col("id").alias(key), *measures, bits.alias("fail_bits"))


def _once(**columns: Column) -> Column:
    """The columns as the one row of a generator, which the optimiser doesn't copy into every later use of them."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _adjacent(words: str) -> Column:
    """How many words equal the one before."""
    w = F.col(words)
    rest = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(w, rest, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))


def apply_policies(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """A ledger with one boolean `pass_<version>` column per policy."""
    policies = POLICIES if policies is None else policies
    return rows.withColumns({f"pass_{v}": F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) == 0 for v, m in policies.items()})


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: failures, failures by that rule alone, and what passes without it.

    One bitwise aggregation: the ledger is first counted by `fail_bits` (at most
    2 ** rules groups, combined on the map side), and only those counts meet the
    policies. An empty ledger gives every policy and rule with zeros.
    """
    policies = POLICIES if policies is None else policies
    spark = rows.sparkSession
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(v, m, r.name, 1 << r.bit) for v, m in policies.items() for r in RULES if m >> r.bit & 1], "policy string, mask long, rule string, bit long")
    seen = F.col("fail_bits").bitwiseAND(F.col("mask"))
    tally = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return grid.join(counts, F.lit(True), "left").groupBy("policy", "rule").agg(
        tally(seen.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        tally(seen == F.col("bit")).alias("failed_alone"),
        tally(seen == 0).alias("passed"),
        tally(seen.bitwiseAND(F.bitwise_not("bit")) == 0).alias("passed_without"),
    )


def accept(docs: DataFrame, version: str = CURRENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns as they were, that pass a policy.

    The bits are computed beside the row, so nothing is joined or shuffled. NULL
    and empty texts fail where the policy holds `empty`.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    judged = (ledger if version in POLICIES else later_ledger)(row, "_text", "_row")
    kept = judged.filter(F.col("fail_bits").bitwiseAND(F.lit((POLICIES | LATER_POLICIES)[version]).cast("long")) == 0)
    return kept.select("_row.*")


_LEDGER_SQL = r"""b AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'), ' ') AS w FROM {docs}),
p AS (SELECT *, CASE WHEN w = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(w, ' ') END AS ws, string_split(t, chr(10)) AS ls FROM b),
m AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words,
  (length(t) - length(translate(t, '#$%&*', ''))) / greatest(length(t), 1) AS symbol_ratio,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) / greatest(length(t), 1) AS upper_ratio,
  (length(t) - length(replace(t, '!', ''))) / greatest(len(ws), 1) AS bang_ratio,
  len(list_distinct(ws)) / greatest(len(ws), 1) AS distinct_ratio,
  len(list_filter(list_zip(ws[:-2], ws[2:]), lambda x: x[1] = x[2])) / greatest(len(ws), 1) AS adjacent_ratio,
  (len(ls) - len(list_distinct(ls))) / len(ls) AS line_dup_ratio,
  (length(t) - length(replace(t, '|', ''))) / greatest(len(ws), 1) AS pipe_ratio,
  length(replace(w, ' ', '')) / greatest(len(ws), 1) AS mean_word FROM p),
l AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)"""


def ledger_sql(docs: str = "documents") -> str:
    """The ledger as the CTE `l` in DuckDB SQL."""
    return _LEDGER_SQL.format(docs=docs, bits=" + ".join(f"CASE WHEN {r.sql} THEN {1 << r.bit} ELSE 0 END" for r in RULES))


_LATER_SQL = r"""n AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id AS id, text FROM documents),
{ledger},
x AS (SELECT doc_id AS r, {measures} FROM p),
y AS (SELECT n.id AS doc_id, l.* EXCLUDE (doc_id), x.* EXCLUDE (r) FROM l JOIN n ON l.doc_id = n.r JOIN x ON x.r = n.r),
z AS (SELECT * REPLACE (CAST(fail_bits + {bits} AS BIGINT) AS fail_bits) FROM y)"""

_LATER_MEASURES_SQL = {
    "window_ratio": f"len(list_distinct(list_transform(range(len(ws)), lambda i: concat(i // {WINDOW}, ' ', ws[i + 1])))) / greatest(len(ws), 1)",
    "full_line_dup_ratio": r"(len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) - len(list_distinct(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')))) / greatest(len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')), 1)",
}


def later_ledger_sql() -> str:
    """The later ledger as the CTE `z` in DuckDB SQL."""
    measures = ", ".join(f"{q} AS {m}" for m, q in _LATER_MEASURES_SQL.items())
    return _LATER_SQL.format(ledger=ledger_sql("(SELECT r AS doc_id, text FROM n)"), measures=measures, bits=" + ".join(f"CASE WHEN {r.sql} THEN {1 << r.bit} ELSE 0 END" for r in LATER_RULES))
