"""The operators' queries on the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import arc, bpe, chat, crosstok, htmltext, langid, mixing, nndescent, quality, repeats, secrets, simhash, spelling

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_nn_descent": nndescent.op2_nn_descent,
    "op3_warc": arc.op3_warc,
    "op4_simhash": simhash.op4_simhash,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_extraction": htmltext.op9_html_extraction,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_cross_tokenizer": crosstok.op12_cross_tokenizer,
    "op13_suffix_dedup": repeats.op13_suffix_dedup,
}

ORACLE_SQL = {
    "op3_warc": arc.OP3_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
