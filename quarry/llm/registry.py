"""The package's queries, and SQL for what SQL can express."""

from __future__ import annotations

from quarry.llm import op7_substrings as substrings
from quarry.llm import op9_minhash as minhash
from quarry.llm.common import prepare
from quarry.llm.op1_language import op1_language
from quarry.llm.op2_pii import op2_pii
from quarry.llm.op3_mixing import op3_mixing
from quarry.llm.op4_licenses import op4_licenses
from quarry.llm.op5_sentencepiece import op5_sentencepiece
from quarry.llm.op6_media import op6_media
from quarry.llm.op7_substrings import op7_substrings
from quarry.llm.op8_chunks import op8_chunks
from quarry.llm.op9_minhash import op9_minhash
from quarry.llm.op10_quality import op10_quality

QUERIES = {f.__name__: f for f in (op1_language, op2_pii, op3_mixing, op4_licenses, op5_sentencepiece, op6_media, op7_substrings, op8_chunks, op9_minhash, op10_quality)}
#: The exact contracts of two operators can be said in SQL. The others return model scores,
#: roundings by hashed coins, or digests of what a method makes of a text; tests/llm holds
#: them against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {"op7_substrings": substrings.SQL, "op9_minhash": minhash.SQL}

__all__ = ["ORACLES", "QUERIES", "prepare"]
