"""SQL twins (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

from quarry.llm import exact_dedup, tool_calls

SQL: dict[str, str] = {"op2_tool_calls": tool_calls.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE}
