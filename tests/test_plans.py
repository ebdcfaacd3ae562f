"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()

# Python runs only for the oversized split, archive unpacking, vector products and stream state.
PYTHON = {"ix14", "ix15", "ix16", "ix18", "rt1", "rt2", "rt3", "rt4", "rt12", "st3"}
SAMPLE = [
    "flagship_worst_sources", "fp1_all_line_rules", "se10_password_equality", "se11_csrf", "ix1_diff_snapshot", "ix6_resolve_imports",
    "ix8_decorator_endpoints", "ix13_module_chunks", "ix15_section_chunks", "u1_upsert", "u4_status_only", "dl10_ci_rollup", "dl11_pr_diff",
    "in3_detect_incidents", "in5_correlate_deployment", "in8_correlate_findings", "in13_blast_radius", "wh1_route_webhooks", "tm2_complexity_code",
    "tm6_nesting_depth", "tm9_duplicate_locations", "tm11_unused_imports", "tm22_halstead_code", "tm30_strategy_candidates", "gr10_unsafe_dependencies",
    "gr12_dependents", "gr13_pr_impact_list", "gr14_named_edges", "fp5_top_findings_review", "fp10_explaining_findings", "rt1_vector_search",
    "rt5_pack_context", "rt8_dedupe_citations", "ro2_top_contributors", "rep1_json_report", "sc1_category_scores",
]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_pairing_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name.split("_")[0] not in PYTHON:
        assert not re.search(r"InPandas|InArrow|PythonUDF|BatchEvalPython|ArrowEvalPython", text)


@pytest.mark.parametrize("name", ["fp5_top_findings_review", "ro2_top_contributors", "rt5_pack_context", "in1_dedupe_alerts", "gr14_named_edges"])
def test_rows_are_cut_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .* Partial", plan(spark, name))


def test_scan_reads_only_what_is_needed(spark):
    text = plan(spark, "ro1_commit_activity")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:" in text
    text = plan(spark, "dl9_importable")
    assert "PushedFilters: [IsNotNull(o_custkey)], ReadSchema: struct<o_custkey:bigint>" in text


def test_changed_hashes_shuffle_without_texts(spark):
    text = plan(spark, "ix1_diff_snapshot")
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("content#" not in line for line in exchanges)


@pytest.mark.parametrize("name", [n for n in QUERIES if re.match(r"(tm(1|2|6|8|9|1[0-9]|2[0-245])|nx\d|ix10)_", n)
                                  and n not in ("tm11_unused_imports", "tm9_repeated_documents")])
def test_trees_are_dealt_by_file_once(spark, name):
    """Landing deals the files; after it, only what is not by file (copies, totals, source texts) moves."""
    text = plan(spark, name)
    assert len(re.findall(r"Exchange (?!Hashed|Single)", text)) <= 3


def test_page_trees_move_pages_only(spark):
    """As landing runs it: both sides of a union deal the pages, nothing after that moves."""
    from tidemark.plans import bindings

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = bindings.page_trees(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", text)) <= 2
