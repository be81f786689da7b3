"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .op10_media import op10_media
from .op1_token_index import op1_token_index
from .op2_quality import op2_quality
from .op3_chat import SQL as OP3_SQL
from .op3_chat import op3_chat
from .op4_spotsigs import op4_spotsigs
from .op5_license import op5_license
from .op5_license import sql as op5_sql
from .op6_language import op6_language
from .op7_simhash import op7_simhash
from .op8_bpe import op8_bpe
from .op9_packing import op9_packing

QUERIES = {
    "op1_token_index": op1_token_index,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_spotsigs": op4_spotsigs,
    "op5_license": op5_license,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
}
ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op5_license": op5_sql()}
