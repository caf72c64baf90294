"""Queries of this subpackage and the SQL of those that SQL can express."""

from . import hnsw, html_main, langid, minhash, mixing, periodic, pieces, token_counts, token_output, topk, toxicity, warc, whiten

QUERIES = {
    "op1_html": html_main.op1_html,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_warc": warc.op4_warc,
    "op5_minhash": minhash.op5_minhash,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_langid": langid.op7_langid,
    "op8_pieces": pieces.op8_pieces,
    "op9_token_output": token_output.op9_token_output,
    "op10_mixing": mixing.op10_mixing,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_whitening": whiten.op13_whitening,
}
ORACLE_SQL = {"op3_topk": topk.ORACLE, "op4_warc": warc.ORACLE}
