"""One query for each operator of this folder, over its whole table with production parameters, and its SQL where there is one."""
from kinweave.llm import (centroids, decontamination, fingerprints, jaccard, mixing, personal, ranking, secret_scan, sharding, simhash,
                          token_counts, toxicity, warc)
from kinweave.llm.tables import table


def op1_jump_shards(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


def op2_kneser_ney_toxicity(spark, folder):
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_linked_secrets(spark, folder):
    return secret_scan.report(table(spark, folder, "documents"))


def op4_bootstrapped_personal(spark, folder):
    return personal.report(table(spark, folder, "documents"))


def op5_quartile_digest(spark, folder):
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op6_indexed_warc(spark, folder):
    return warc.archive_pages(table(spark, folder, "pages"))


def op7_water_filling(spark, folder):
    return mixing.mix_words(table(spark, folder, "documents"))


def op8_prefix_decontamination(spark, folder):
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_trie_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"))


def op10_multi_order_jaccard(spark, folder):
    return jaccard.join_components(table(spark, folder, "documents"))


def op11_vantage_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op12_vantage_centroids(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"))


def op13_stratified_search(spark, folder):
    return ranking.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_jump_shards, op2_kneser_ney_toxicity, op3_linked_secrets, op4_bootstrapped_personal, op5_quartile_digest, op6_indexed_warc,
    op7_water_filling, op8_prefix_decontamination, op9_trie_token_counts, op10_multi_order_jaccard, op11_vantage_simhash,
    op12_vantage_centroids, op13_stratified_search)}

ORACLES = {
    "op7_water_filling": f"""WITH {mixing.MIX_SQL.format(docs="documents")}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * times AS BIGINT) AS taken FROM mix""",
    "op12_vantage_centroids": centroids.cluster_sql(),
    "op13_stratified_search": ranking.search_sql(),
}
