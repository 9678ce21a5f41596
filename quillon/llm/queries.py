"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from quillon.llm.archive import OP1_SQL, op1_arc_to_warc
from quillon.llm.bpe_automaton import op11_bpe_automaton
from quillon.llm.byte_bpe import op10_byte_bpe
from quillon.llm.collocations import op12_collocations
from quillon.llm.decontaminate import op9_decontaminate
from quillon.llm.host_rules import OP7_SQL, op7_host_rules
from quillon.llm.license_scan import op4_license_scan
from quillon.llm.license_scan import oracle as license_sql
from quillon.llm.sharding import op3_bin_packing
from quillon.llm.simhash import op8_simhash
from quillon.llm.suffix_dedup import op2_suffix_dedup
from quillon.llm.token_alignment import op13_alignment
from quillon.llm.token_orc import op6_token_orc
from quillon.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bin_packing": op3_bin_packing,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_token_orc": op6_token_orc,
    "op7_host_rules": op7_host_rules,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_bpe_automaton": op11_bpe_automaton,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op1_arc_to_warc": OP1_SQL,
    "op4_license_scan": license_sql(),
    "op5_url_filter": OP5_SQL,
    "op7_host_rules": OP7_SQL,
}
