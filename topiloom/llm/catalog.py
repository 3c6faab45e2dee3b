"""The queries of this subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from topiloom.llm import (
    bpe,
    decontaminate,
    html_text,
    language_id,
    licences,
    line_dedup,
    minhash,
    mixing,
    nn_descent,
    pii,
    runs,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_html_text": html_text.op4_html_text,
    "op5_bpe": bpe.op5_bpe,
    "op6_minhash": minhash.op6_minhash,
    "op7_licences": licences.op7_licences,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_nn_descent": nn_descent.op10_nn_descent,
    "op11_runs": runs.op11_runs,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_mixing": mixing.op13_mixing,
}

SQL = {
    "op6_minhash": minhash.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_mixing": mixing.SQL,
}
