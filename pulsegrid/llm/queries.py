"""Queries over the training-data operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pulsegrid.llm.decontaminate import op5_decontaminate
from pulsegrid.llm.lang_id import op2_lang_id
from pulsegrid.llm.lattice import op8_lattice
from pulsegrid.llm.licenses import op10_licenses
from pulsegrid.llm.mixing import op9_mixing
from pulsegrid.llm.near_dup import op1_near_dup
from pulsegrid.llm.oracles import ORACLES  # noqa: F401
from pulsegrid.llm.pii import op3_pii
from pulsegrid.llm.secrets import op7_secrets
from pulsegrid.llm.token_counts import op6_token_counts
from pulsegrid.llm.token_file import op4_token_file

QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_lang_id": op2_lang_id,
    "op3_pii": op3_pii,
    "op4_token_file": op4_token_file,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_secrets": op7_secrets,
    "op8_lattice": op8_lattice,
    "op9_mixing": op9_mixing,
    "op10_licenses": op10_licenses,
}
