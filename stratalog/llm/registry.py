"""All queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_text as t

QUERIES = {f.__name__: f for f in (t.op1_suffix_dedup, t.op2_personal_data, t.op3_quality, t.op4_media_columns, t.op5_minhash_near_dedup, t.op6_source_mixing, t.op7_exact_dedup, t.op8_warc, t.op9_language_id, t.op10_bpe)}
SQL = {**t.SQL}
