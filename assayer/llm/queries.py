"""Every query of this subpackage with its SQL, where SQL can say it."""

from __future__ import annotations

from assayer.llm import q_group_split, q_leaks, q_ledger, q_overlap, q_packing, q_quality, q_quota_sample, q_residue

_MODULES = (q_ledger, q_overlap, q_residue, q_group_split, q_quota_sample, q_packing, q_leaks, q_quality)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
