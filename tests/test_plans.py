"""What the physical plans must and must not contain."""

import pytest

from fieldloom.plans import load_queries
from fieldloom.plans.views import latent_fields
from fieldloom.sources.fieldstore import open_colocated, write_colocated

QUERIES = load_queries()[0]

# Sequential steps, stencils, array arithmetic on packed fields and code tables of whole groups; streams run while the query is built.
PYTHON = {
    "e13_pmf_to_cdf", "s04_decode_npy", "e11_channel_gains",
    "g05_downsample_avg", "g07_regrid_bilinear", "g08_gaussian_blur", "n06_minmax_quantize", "n07_minmax_dequantize",
    "g05_downsample_avg_gaps", "g07_regrid_bilinear_gaps", "g08_gaussian_blur_gaps", "n06_minmax_quantize_gaps",
    "c03_stack_channels", "c04_unstack_channels", "t08_accumulate_fields", "t08_accumulate_fields_gaps",
    "t06_climatology_lookup", "t07_daily_climatology", "m03_weighted_rmse", "m04_anomaly_correlation", "m05_bias_activity",
    "n01_field_stats", "n01_field_stats_gaps", "n04_standardize_fields", "n04_standardize_fields_unknown",
    "n05_destandardize_fields", "q01_quantize_dequantize_fields", "q02_quantize_symbols_fields", "q03_dequantize_fields",
    "q05_scale_index_fields", "q05_scale_index_fields_gaps", "e14_likelihood_fields", "e14_likelihood_fields_gaps",
    "e15_bits_from_fields", "e15_bits_from_fields_gaps",
    "e02_symbol_cdf", "e02_symbol_cdf_gaps", "e03_most_probable_symbol", "e04_cross_entropy", "e04_cross_entropy_gaps",
    "e06_context_cdf", "e06_context_cdf_gaps", "e07_context_entropy", "e08_threshold_entropy", "e10_channel_context_entropy",
    "m03_weighted_rmse_fields_gaps", "m04_anomaly_correlation_fields_gaps", "m05_bias_activity_fields_gaps",
}
STREAMS = {n for n in QUERIES if n.startswith("w0")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    has_python = any(x in text for x in ("InPandas", "ArrowEvalPython", "BatchEvalPython", "MapInArrow"))
    assert has_python == (name in PYTHON)


# Queries whose operator moves or combines cells without any exchange of cells.
NARROW = [
    "c09_split_moments", "g01_crop", "g02_pad_center", "g03_unpad", "g04_tile", "g04_untile", "g05_downsample_avg",
    "g06_regrid_nearest", "g07_regrid_bilinear", "g08_gaussian_blur", "g09_space_to_depth", "g10_rgb_to_ycbcr",
    "n04_standardize", "n05_destandardize", "n06_minmax_quantize", "n07_minmax_dequantize", "q01_quantize_dequantize",
    "q04_quantize_noise", "q05_scale_index", "s01_field_manifest", "s06_container_catalog", "s07_container_pack",
    "s13_tuplet_expand", "s14_video_name_metadata", "e14_gaussian_likelihood",
    "n04_standardize_fields", "n05_destandardize_fields", "q01_quantize_dequantize_fields", "q05_scale_index_fields",
    "e14_likelihood_fields",
]


def outside_cache(text):
    """The plan's lines without those of summaries that are computed once and kept."""
    depth = None
    for line in text.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            continue
        depth = at if "InMemoryRelation" in line else None
        yield line


@pytest.mark.parametrize("name", NARROW)
def test_cells_are_not_shuffled(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    exchanges = [x for x in outside_cache(text) if "Exchange" in x and "BroadcastExchange" not in x]
    assert len(exchanges) == (1 if name == "s01_field_manifest" else 0), exchanges  # its input is a distinct


@pytest.mark.parametrize("name", ["n08_cumulative_mse", "n08_cumulative_mse_gaps", "n11_ema", "n11_ema_gaps", "e02_symbol_cdf", "e10_channel_context_entropy"])
def test_no_single_task(spark, sf, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, sf))


def test_gains_shuffle_bands_and_counts_only(spark, sf):
    text = "\n".join(outside_cache(plan(QUERIES["e11_channel_gains"](spark, sf))))
    assert "Exchange hashpartitioning(sample" not in text.replace("band#", "") or "band#" in text
    assert not [x for x in text.splitlines() if "Exchange" in x and "sample#" in x and "band#" not in x]


@pytest.mark.parametrize("name", ["t07_daily_climatology", "m03_weighted_rmse"])
def test_fields_are_shuffled_whole(spark, sf, name):
    """What is exchanged is keyed by time and channel, never by a cell."""
    text = plan(QUERIES[name](spark, sf))
    assert not [x for x in text.splitlines() if "Exchange hashpartitioning" in x and (" i#" in x or "(i#" in x)]


def test_colocated_fields_join_without_a_shuffle(spark, sf, tmp_path):
    """In the session that wrote the tables and in one that only knows their place."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["c07_field_diff_colocated"](spark, sf))
        assert "SortMergeJoin" in text and "Exchange" not in text
        fields = latent_fields(spark, sf)
        left = write_colocated(fields, "stored_a", str(tmp_path / "a"), ["sample", "c"], 4)
        write_colocated(fields, "stored_b", str(tmp_path / "b"), ["sample", "c"], 4)
        spark.sql("DROP TABLE stored_b")
        schema = ", ".join(f"{n} {t}" for n, t in fields.dtypes)
        right = open_colocated(spark, "stored_b", str(tmp_path / "b"), schema, ["sample", "c"], 4)
        joined = left.join(right.withColumnRenamed("values", "other"), ["sample", "c"])
        assert "Exchange" not in plan(joined) and joined.where("values = other").count() == fields.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stacking_shuffles_bands(spark, sf):
    exchanges = [x for x in plan(QUERIES["c03_stack_channels"](spark, sf)).splitlines() if "Exchange" in x]
    assert len(exchanges) == 1 and "sample#" in exchanges[0] and "_first#" in exchanges[0]


def test_contexts_shuffle_summaries_only(spark, sf):
    text = plan(QUERIES["e05_spatial_context"](spark, sf))
    assert not [x for x in outside_cache(text) if "Exchange hashpartitioning(sample" in x]


def test_only_needed_columns_are_read(spark, sf):
    text = plan(QUERIES["t05_date_split"](spark, sf))
    schema = text[text.index("ReadSchema"):].split(">")[0]
    assert "l_shipdate" in schema and "l_extendedprice" in schema and "l_orderkey" not in schema
    pushed = text[text.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed


def test_derived_arrays_are_computed_once(spark, sf):
    text = plan(QUERIES["g08_gaussian_blur"](spark, sf))
    assert "Filter (size(" not in text


def test_leading_rows_are_cut_before_the_shuffle(spark, sf):
    for name in ("s12_clip_frame_sampler", "t09_every_kth_step"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))
