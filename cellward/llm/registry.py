"""The queries of this subpackage by name, and the SQL that checks them."""

from cellward.llm import bpe, decontaminate, licenses, near, periods, quality, repeats, secrets, spellings, token_files, urls, vectors, warc

QUERIES = {
    "op1_bpe_encoding": bpe.op1_bpe_encoding,
    "op2_url_filter": urls.op2_url_filter,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_token_id_output": token_files.op5_token_id_output,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_ngram_jaccard_join": near.op8_ngram_jaccard_join,
    "op9_warc_derivatives": warc.op9_warc_derivatives,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_spelling_variants": spellings.op11_spelling_variants,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_embedding_near_dedup": vectors.op13_embedding_near_dedup,
}

ORACLES = {
    "op2_url_filter": urls.OP2_SQL,
    "op4_suffix_dedup": repeats.OP4_SQL,
    "op9_warc_derivatives": warc.OP9_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
}
