"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from loomgraph.llm import binpack, bpe, licenses, near_vectors, ngram_join, packing, prefix_trie, quality_classifier, quality_rules, secrets, sharding, sql, turn_repair, url_filters


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": _pipeline,
    "op10_attention_mil": quality_classifier.op10_attention_mil,
    "op8_nn_descent": near_vectors.op8_nn_descent,
    "op2_multipart_credentials": secrets.op2_multipart_credentials,
    "op1_distribution_divergence": quality_rules.op1_distribution_divergence,
    "op5_ngram_vertical_join": ngram_join.op5_ngram_vertical_join,
    "op4_best_fit_packing": binpack.op4_best_fit_packing,
    "op3_mixture_packing": packing.op3_mixture_packing,
    "op6_feistel_sharding": sharding.op6_feistel_sharding,
    "op7_glob_url_filter": url_filters.op7_glob_url_filter,
    "op9_bpe_tree_encode": bpe.op9_bpe_tree_encode,
    "op11_ordered_license_rules": licenses.op11_ordered_license_rules,
    "op12_survivor_viterbi": turn_repair.op12_survivor_viterbi,
    "op13_monoid_prefix_trie": prefix_trie.op13_monoid_prefix_trie,
}

SQL = {
    "op1_distribution_divergence": sql.op1(),
    "op2_multipart_credentials": sql.op2(),
    "op5_ngram_vertical_join": sql.op5(),
    "op7_glob_url_filter": url_filters.op7_sql(),
    "op8_nn_descent": sql.op8(),
    "op11_ordered_license_rules": licenses.op11_sql(),
    "op12_survivor_viterbi": turn_repair.op12_sql(),
    "op13_monoid_prefix_trie": prefix_trie.op13_sql(),
}
