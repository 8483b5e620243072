"""Ladders over the flags of a loop, an item or a function: the first rule that holds gives the kind.

A rule's condition is SQL over boolean columns, so that any engine can run a ladder.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of loop regions and when they apply, in this order.
VECTOR = "child and spec and not irregular and not side_call and not array_write and reduction"
REGIONS = (
    ("two_pointer_swap", "while_header and two_pointer"),
    ("pseudocode_control", "while_header or while_kind"),
    ("hybrid_scalar_region_per_element", "child and branch and outer_local"),
    ("pseudocode_loop", "branch and branch_control"),
    ("pseudocode_loop", "branch and condition_update"),
    ("prefix_scan_predicate", "carried_output and prefix_scan"),
    ("pseudocode_loop", "carried_output"),
    ("hybrid_elementwise_reduction", f"{VECTOR} and local_child"),
    ("prefix_scan_predicate", "branch and (state_control or condition_state) and prefix_scan"),
    ("pseudocode_loop", "branch and (state_control or condition_state)"),
    ("pseudocode_loop", "branch and state_update and compound_scalar"),
    ("hybrid_scalar_region_per_element", "child and branch_inside and state_update and per_element"),
    ("pseudocode_loop", "child and branch_inside and state_update"),
    ("bounded_predicate_scan", "controls and branch and spec and state_update"),
    ("predicate_return_scan", "branch and not child and predicate_return and not irregular and not string_condition"),
    ("arg_reduction", "branch and not child and spec and not irregular and not string_condition and selection and selection_index"),
    ("pseudocode_loop", "branch and not child and spec and not irregular and not string_condition and selection"),
    ("pseudocode_loop", "branch and return_inside"),
    ("affine_recurrence_closed_form", "dependency and closed_form"),
    ("prefix_or_neighbor_dependency", "dependency and near_index"),
    ("dependency_or_inplace_update", "dependency"),
    ("hybrid_elementwise_reduction", VECTOR),
    ("hybrid_elementwise_store", "child and spec and not irregular and not side_call and array_write and local_scalar"),
    ("conflict_update", "indirect_compound"),
    ("nested_reduction_update", "array_compound and (fixed_index or two_loops)"),
    ("array_update", "array_compound"),
    ("prefix_or_rolling_output", "not child and reduction and array_write"),
    ("scalar_reduction", "reduction"),
    ("predicate_store_map", "branch and array_write"),
    ("indexed_gather_scatter_map", "array_write and indirect"),
    ("store_map", "array_write"),
)
REGION_FLAGS = (
    "while_header", "two_pointer", "while_kind", "child", "branch", "outer_local", "branch_control", "condition_update", "carried_output", "prefix_scan", "spec", "local_child", "irregular", "side_call", "array_write", "reduction",
    "state_control", "condition_state", "state_update", "compound_scalar", "branch_inside", "per_element", "controls", "predicate_return", "string_condition", "selection", "selection_index", "return_inside", "dependency", "closed_form",
    "near_index", "local_scalar", "indirect_compound", "array_compound", "fixed_index", "two_loops", "indirect",
)

# Region kinds that may run as vectors, and those that may hold an inner loop.
VECTOR_KINDS = (
    "store_map", "predicate_store_map", "indexed_gather_scatter_map", "array_update", "nested_reduction_update", "scalar_reduction", "prefix_or_rolling_output", "prefix_scan_predicate", "bounded_predicate_scan",
    "predicate_return_scan", "arg_reduction", "affine_recurrence_closed_form", "two_pointer_swap", "hybrid_elementwise_reduction", "hybrid_elementwise_store", "hybrid_scalar_region_per_element",
)
HYBRID_KINDS = ("hybrid_elementwise_reduction", "hybrid_elementwise_store", "hybrid_scalar_region_per_element")
quoted = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
RENDERED = (
    f"not aggregate_container and kind in {quoted(VECTOR_KINDS)} and (kind = 'two_pointer_swap' or (not (scheduler and kind <> 'hybrid_scalar_region_per_element') and not pointer_scheduler"
    f" and not (kind = 'nested_reduction_update' and invariant_update) and not pointer_stream and not (child and kind not in {quoted(HYBRID_KINDS)}) and not irregular and spec))"
)
RENDER_FLAGS = ("aggregate_container", "scheduler", "pointer_scheduler", "invariant_update", "pointer_stream", "child", "irregular", "spec")

# Labels of the items in a region; `op` is the assignment's operator, `kind` the region's kind.
LABELS = (
    ("", "initializer"),
    ("init", "declaration and plain_init"),
    ("compute", "declaration"),
    ("scan", "kind in ('prefix_or_rolling_output', 'prefix_scan_predicate') and prefix_update"),
    ("update", "vector and direct_local and scalar_lhs and op <> '='"),
    ("reduce", "reducing and scalar_lhs and op <> '=' and (vector or not local)"),
    ("state_reduce", "vector and kind = 'arg_reduction' and scalar_lhs and op = '=' and boolean_state"),
    ("arg_reduce", "vector and kind = 'arg_reduction' and scalar_lhs and op = '=' and arg_index"),
    ("reduce", "vector and kind = 'arg_reduction' and scalar_lhs and op = '='"),
    ("update", "vector and state_update and not scalar_reduction and kind = 'bounded_predicate_scan'"),
    ("state_reduce", "vector and state_update and not scalar_reduction"),
    ("init", "plain_init"),
    ("conflict_update", "writes and kind = 'conflict_update'"),
    ("carried_update", "writes and kind in ('dependency_or_inplace_update', 'prefix_or_neighbor_dependency') and op <> '='"),
    ("reduce", "writes and kind = 'nested_reduction_update' and op <> '='"),
    ("lane_update", "writes and vector and kind = 'array_update' and op <> '='"),
    ("update", "writes and op <> '='"),
    ("write", "writes"),
    ("reduce", "scalar_reduction and vector and reducing"),
    ("update", "scalar_reduction and local"),
    ("reduce", "scalar_reduction and reducing"),
    ("scan", "scalar_reduction and kind in ('prefix_or_rolling_output', 'prefix_scan_predicate') and vector"),
    ("reduce", "scalar_reduction and vector and kind not in ('prefix_or_rolling_output', 'prefix_scan_predicate', 'pseudocode_control', 'pseudocode_loop')"),
    ("update", "scalar_reduction"),
    ("update", "op <> '='"),
    ("update", "scalar_lhs and not reads"),
)
LABEL_FLAGS = ("initializer", "declaration", "plain_init", "prefix_update", "vector", "direct_local", "scalar_lhs", "reducing", "local", "boolean_state", "arg_index", "state_update", "scalar_reduction", "writes", "reads")

# Patterns of a function by the features that were seen in it, in this order.
ROUTES = (
    ("stencil_or_window", "stencil_or_window"),
    ("row_pointer_expand_or_copy", "row_or_plane_pointer_layout and (duplicate_stream_store or adjacent_row_or_neighbor_copy)"),
    ("row_pointer_fixed_point_map", "row_or_plane_pointer_layout and fixed_point_numeric_map"),
    ("interleaved_fixed_point_channel_map", "interleaved_channel_map and fixed_point_numeric_map"),
    ("two_pass_statistic", "two_pass_statistic"),
    ("row_pointer_layout", "row_or_plane_pointer_layout"),
    ("fixed_point_numeric_map", "fixed_point_numeric_map"),
    ("transcendental_or_polynomial", "transcendental_or_polynomial"),
    ("interleaved_channel_map", "interleaved_channel_map"),
    ("scan_or_prefix_monoid", "scan_or_prefix_monoid or (carried_dependency_or_raw and neighbor_read_write)"),
    ("reverse_or_two_pointer_swap", "carried_dependency_or_raw"),
    ("reduction_or_two_pass", "reduction_or_accumulator or scalar_reduction_return"),
    ("predicate_select_store_map", "predicate_or_select_map"),
    ("compact_or_streaming_write", "compact_or_streaming_index"),
    ("store_map", "array_write and (strided_or_flattened_layout or nested_loop)"),
    ("numeric_conversion_lane_mapping", "numeric_conversion"),
    ("bit_shift_or_rotate", "bitwise_or_shift"),
    ("scalar_or_irregular_control", "irregular_text"),
)
ROUTE_FLAGS = (
    "stencil_or_window", "row_or_plane_pointer_layout", "duplicate_stream_store", "adjacent_row_or_neighbor_copy", "fixed_point_numeric_map", "interleaved_channel_map", "two_pass_statistic", "transcendental_or_polynomial", "scan_or_prefix_monoid",
    "carried_dependency_or_raw", "neighbor_read_write", "reduction_or_accumulator", "scalar_reduction_return", "predicate_or_select_map", "compact_or_streaming_index", "array_write", "strided_or_flattened_layout", "nested_loop",
    "numeric_conversion", "bitwise_or_shift", "irregular_text",
)


def ladder_case(rules: tuple[tuple[str, str], ...], default: str) -> str:
    """A ladder as a SQL CASE; a null flag counts as false where it stands alone."""
    return "CASE " + " ".join(f"WHEN {when} THEN '{kind}'" for kind, when in rules) + f" ELSE '{default}' END"


def region_kind() -> Column:
    """The kind of a loop region, from columns named as REGION_FLAGS."""
    return F.expr(ladder_case(REGIONS, "pseudocode_loop"))


def runs_as_vector() -> Column:
    """Whether a region is rendered as a vector loop, from `kind` and columns named as RENDER_FLAGS."""
    return F.expr(RENDERED)


def item_label() -> Column:
    """The label of an item, from `kind`, `op` and columns named as LABEL_FLAGS."""
    return F.expr(ladder_case(LABELS, "compute"))


def route() -> Column:
    """The pattern of a function, from columns named as ROUTE_FLAGS."""
    return F.expr(ladder_case(ROUTES, "generic_code_like_pseudocode"))


def route_style(pattern: Column) -> Column:
    return F.when(pattern.isin("scalar_or_irregular_control", "generic_code_like_pseudocode"), "pseudocode").otherwise("dataflow_pseudocode")


def is_malformed_line(line: Column) -> Column:
    """Blank, or an operator at the end, or more opening than closing brackets outside quotes without an ellipsis at the end."""
    text = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", "")
    bare = F.regexp_replace(text, r""""(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)""", " ")
    opened = F.regexp_count(bare, F.lit(r"\(")) > F.regexp_count(bare, F.lit(r"\)"))
    return (text == "") | F.rlike(text, F.lit(r"[-+*/&|^]$")) | (opened & ~F.endswith(text, F.lit("...")))
