"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from waylark.llm.ann import op7_ann
from waylark.llm.chat_format import op6_chat_format
from waylark.llm.decontaminate import op5_decontaminate
from waylark.llm.jaccard_join import op2_jaccard_join
from waylark.llm.language_id import op3_language_id
from waylark.llm.license_scan import op4_license_scan
from waylark.llm.mixing import op10_mixing
from waylark.llm.oracle import ORACLE_SQL
from waylark.llm.token_count import op9_token_count
from waylark.llm.url_filter import op1_url_filter
from waylark.llm.warc import op8_warc

QUERIES: dict[str, Callable] = {
    "op1_url_filter": op1_url_filter,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat_format": op6_chat_format,
    "op7_ann": op7_ann,
    "op8_warc": op8_warc,
    "op9_token_count": op9_token_count,
    "op10_mixing": op10_mixing,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
