"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from crawlspan.llm import ann, ctw, packing, pieces, rules, simhash, substring, token_counts, toxicity, url_filter
from crawlspan.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_PASS = ", ".join(f"(fail_bits & {m}) = 0 AS pass_{v}" for v, m in rules.POLICIES.items())


@query("op8_quality_rules", f"WITH {rules.ledger_sql()} SELECT *, {_PASS} FROM l")
def op8_quality_rules(spark, sf_dir):
    return rules.apply_policies(rules.ledger(table(spark, sf_dir, "documents")))


_LATER_PASS = ", ".join(f"(fail_bits & {m}) = 0 AS pass_{v}" for v, m in rules.LATER_POLICIES.items())


@query("op8_quality_rules_later", f"WITH {rules.later_ledger_sql()} SELECT *, {_LATER_PASS} FROM z")
def op8_quality_rules_later(spark, sf_dir):
    return rules.apply_policies(rules.later_ledger(table(spark, sf_dir, "documents")), rules.LATER_POLICIES)


_GRID = ", ".join(f"('{v}', {m}, '{r.name}', {1 << r.bit})" for v, m in rules.POLICIES.items() for r in rules.RULES if m >> r.bit & 1)


@query(
    "rule_ablations",
    f"""WITH {rules.ledger_sql()}, g(policy, mask, rule, bit) AS (VALUES {_GRID})
SELECT policy, rule, count_if(fail_bits & bit <> 0) AS failed, count_if(fail_bits & mask = bit) AS failed_alone,
  count_if(fail_bits & mask = 0) AS passed, count_if((fail_bits & mask) & ~bit = 0) AS passed_without
FROM l CROSS JOIN g GROUP BY policy, rule""",
)
def rule_ablations(spark, sf_dir):
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    return url_filter.score(table(spark, sf_dir, "pages"))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.duplicates(table(spark, sf_dir, "documents"))


@query("op5_context_tree_weighting")
def op5_context_tree_weighting(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"), depth=ctw.DEEPEST)


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    return substring.passages(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
