"""The operators' queries on the driver's tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from ..storage import settled
from . import best_fit_packing, chat_format, chat_repair, language_id, latent_decontamination, ngram_join, periodic_runs, pii_crf, quality_classifier, quality_rules, secret_ledger, substring_dedup, warc

QUERIES = {
    "op1_chat_windows": chat_format.op1_chat_windows,
    "op2_repetition_quality": quality_rules.op2_repetition_quality,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_pii_crf": pii_crf.op4_pii_crf,
    "op5_latent_decontamination": latent_decontamination.op5_latent_decontamination,
    "op6_cotraining_quality": quality_classifier.op6_cotraining_quality,
    "op7_sentence_spans": substring_dedup.op7_sentence_spans,
    "op8_best_fit_packing": best_fit_packing.op8_best_fit_packing,
    "op9_language_id": language_id.op9_language_id,
    "op10_secret_ledger": secret_ledger.op10_secret_ledger,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_warc_writer": warc.op12_warc_writer,
    "op13_chat_repair": chat_repair.op13_chat_repair,
}
#: What operators write on the way is gone when a query returns.
QUERIES = {name: settled(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {"op10_secret_ledger": secret_ledger.SQL, "op12_warc_writer": warc.SQL, "op13_chat_repair": chat_repair.SQL}
