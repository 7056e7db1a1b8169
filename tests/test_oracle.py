"""Registered queries against their SQL at the smallest scale. FOLIO_ALL=1 takes all of them."""

import os

import pytest

import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = """
cer box_iou is_contained letterbox_boxes parse_date coerce_json validate_extraction encode_label clean_list_block words_in_elements
label_blocks drop_contained_same_class best_line match_detections average_precision nms cluster_x merge_bars merge_active_cells running_best
merge_spans place_cells reading_order_simple region_edges precedence_edges render_markdown page_csv text_layer squad_scores extraction_scores
rouge_n stage_percentiles gate sample_exact mix_datasets task_prompts chat_prompt nearest_column connector_edges gantt_tasks read_coco
infer_with_fallback stream_stage_latency stream_unfinished incremental_ground_truth
""".split()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("FOLIO_ALL") else QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare.difference(spark, con, SF, name, entry.queries(), entry.oracle_sql()) is None


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(entry.entry(spark).take(1)) == 1
