"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .conversations import OP11_SQL, op11_conversation_repair
from .flac import op4_flac_media
from .langid import op2_language_id
from .mixing import OP8_SQL, op8_source_mixing
from .quality import op6_quality
from .secrets import op9_secret_scan
from .simhash import op10_simhash_near_dedup
from .spelling import OP12_SQL, op12_spelling_variants
from .substring import OP1_SQL, op1_substring_dedup
from .urls import OP5_SQL, op5_url_filter
from .vafile import OP3_SQL, op3_exact_top_k
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_flac_media": op4_flac_media,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_source_mixing": op8_source_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op3_exact_top_k": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op8_source_mixing": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_warc": OP13_SQL,
}
