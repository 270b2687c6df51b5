"""The benchmark names that may be requested."""

from __future__ import annotations

from hitmill.operators.triage import RepoRules

# Suites and microbenchmarks of an engine repository, and
# microbenchmarks of a library repository, which has no suites.
ENGINE_SUITES = (
    "tpch",
    "tpch10",
    "tpch_mem",
    "tpch_mem10",
    "clickbench_partitioned",
    "clickbench_extended",
    "clickbench_1",
    "clickbench_pushdown",
    "external_aggr",
    "tpcds",
)
ENGINE_MICRO = (
    "sql_planner",
    "in_list",
    "case_when",
    "aggregate_vectorized",
    "array_set_ops",
    "aggregate_query_sql",
    "with_hashes",
    "range_and_generate_series",
    "sort",
    "left",
    "strpos",
    "substr_index",
    "character_length",
    "reset_plan_states",
    "replace",
    "plan_reuse",
)
LIBRARY_MICRO = (
    "arrow_reader",
    "arrow_reader_clickbench",
    "arrow_reader_row_filter",
    "arrow_statistics",
    "arrow_writer",
    "array_iter",
    "array_from",
    "bitwise_kernel",
    "boolean_kernels",
    "buffer_bit_ops",
    "builder",
    "cast_kernels",
    "comparison_kernels",
    "csv_writer",
    "coalesce_kernels",
    "encoding",
    "metadata",
    "json-reader",
    "json_reader",
    "ipc_reader",
    "take_kernels",
    "sort_kernel",
    "interleave_kernels",
    "union_array",
    "variant_builder",
    "variant_kernels",
    "view_types",
    "variant_validation",
    "filter_kernels",
    "concatenate_kernel",
    "row_format",
    "zip_kernels",
)


def published_rules(
    engine: str, library: str, library_prefix: str, commands: dict[str, str] | None = None
) -> tuple[RepoRules, RepoRules]:
    """Rules of both repositories, given their names and the job prefix of the second.

    ``commands`` may name the programs: suite, micro and library.
    """
    named = {"suite": "compare-suite", "micro": "compare-micro", "library": "compare-library"}
    named |= commands or {}
    return (
        RepoRules(engine, ENGINE_SUITES, ENGINE_MICRO, named["suite"], named["micro"]),
        RepoRules(
            library, (), LIBRARY_MICRO, named["library"], named["library"], library_prefix
        ),
    )
