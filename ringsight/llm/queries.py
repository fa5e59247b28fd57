"""Registered queries of this package: operator, its production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from ringsight.llm.common import table
from ringsight.llm.decontaminate import contaminated_pairs
from ringsight.llm.jaccard_join import jaccard_classes
from ringsight.llm.licences import find_licences
from ringsight.llm.mixing import mix_sources, mixing_sql
from ringsight.llm.personal_data import find_personal_data
from ringsight.llm.prefix_trie import prefix_trie, trie_sql
from ringsight.llm.quality import resample
from ringsight.llm.quality_rules import RULES_SQL, judge
from ringsight.llm.secrets import find_secrets
from ringsight.llm.sharding import assign_shards, shards_sql
from ringsight.llm.simplex_clusters import cluster_vectors, clusters_sql
from ringsight.llm.token_counts import count_tokens
from ringsight.llm.toxicity import score_toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


@register("op1_source_mixing", mixing_sql())
def op1(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@register("op2_token_counts")
def op2(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op3_secret_scan")
def op3(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op4_quality_classifier")
def op4(spark, sf_dir):
    kept = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight", "gumbel_key", "kept")


@register("op5_pii")
def op5(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))


@register("op6_quality_rules", RULES_SQL)
def op6(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


@register("op7_licence_scan")
def op7(spark, sf_dir):
    return find_licences(table(spark, sf_dir, "documents"))


@register("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_toxicity")
def op9(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_ngram_jaccard_join")
def op10(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


@register("op11_centroid_clustering", clusters_sql())
def op11(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("n_compared")


@register("op12_sharding", shards_sql())
def op12(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


@register("op13_conversation_prefix_trie", trie_sql())
def op13(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
