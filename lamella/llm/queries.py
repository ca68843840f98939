"""The subpackage's queries, and their SQL where SQL can say it."""

from __future__ import annotations

from lamella.llm import op2, op6
from lamella.llm.op1 import op1_quality
from lamella.llm.op2 import op2_minhash
from lamella.llm.op3 import op3_bpe
from lamella.llm.op4 import op4_token_counts
from lamella.llm.op5 import op5_rules
from lamella.llm.op6 import op6_chat
from lamella.llm.op7 import op7_token_planes
from lamella.llm.op8 import op8_pack
from lamella.llm.op9 import op9_shards
from lamella.llm.op10 import op10_media

QUERIES = {"op1_quality": op1_quality, "op2_minhash": op2_minhash, "op3_bpe": op3_bpe, "op4_token_counts": op4_token_counts, "op5_rules": op5_rules, "op6_chat": op6_chat, "op7_token_planes": op7_token_planes, "op8_pack": op8_pack, "op9_shards": op9_shards, "op10_media": op10_media}
ORACLE = {"op2_minhash": op2.SQL, "op6_chat": op6.SQL}
