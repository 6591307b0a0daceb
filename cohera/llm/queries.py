"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from .bytebpe import op6_byte_bpe
from .idfile import op5_token_ids
from .jaccard import OP10_SQL, op10_jaccard
from .lines import OP1_SQL, op1_line_dedup
from .merkle import OP13_SQL, op13_merkle
from .mpegts import op2_media
from .nearest import OP12_SQL, op12_nearest
from .packing import op4_packing
from .phrases import op8_substrings
from .pii import op9_pii
from .quality import op3_quality
from .topk import OP7_SQL, op7_topk
from .trie import OP11_SQL, op11_trie

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_token_ids": op5_token_ids,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_topk": op7_topk,
    "op8_substrings": op8_substrings,
    "op9_pii": op9_pii,
    "op10_jaccard": op10_jaccard,
    "op11_trie": op11_trie,
    "op12_nearest": op12_nearest,
    "op13_merkle": op13_merkle,
}
ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op7_topk": OP7_SQL,
    "op10_jaccard": OP10_SQL,
    "op11_trie": OP11_SQL,
    "op12_nearest": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
