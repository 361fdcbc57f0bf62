"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontaminate
from .extract import op5_extract
from .mixing import op9_mixing
from .pii import op1_pii
from .ppm import op7_ppm
from .quality import op10_quality
from .secrets import OP3_SQL, op3_secrets
from .simhash import op6_simhash
from .toxicity import op2_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_secrets, op4_warc, op5_extract, op6_simhash, op7_ppm, op8_decontaminate, op9_mixing, op10_quality)}
SQL = {"op3_secrets": OP3_SQL, "op4_warc": OP4_SQL, "op8_decontaminate": OP8_SQL}
