"""What the plans look like: pruned scans, pushed filters, no products where keys exist."""

import contextlib
import io
import re

import pytest

from braidgraph.plans.catalogue import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_needed_columns_only(spark, sf):
    text = plan(QUERIES["node_coverage"](spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lineitem = next(s for s in schemas if "l_orderkey" in s)
    # neither quantities nor discounts, taxes or flags of lines that the query does not use
    assert not {"l_quantity", "l_discount", "l_tax", "l_linestatus"} & {c.split(":")[0] for c in lineitem.split(",")}


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["extract_path"](spark, sf))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(o_custkey\)", text)


@pytest.mark.parametrize("name", ["interval_overlap", "node_offsets", "group_nodes", "two_mers", "repeated_2mers", "bed_resolve", "dangling_filter"])
def test_no_products(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)


@pytest.mark.parametrize("name", ["delta_encode", "delta_encode_2", "two_mers", "orient_bitpack"])
def test_one_exchange(spark, sf, name):
    """Everything along a traversal uses the partitioning that put its steps in order."""
    tree = plan(QUERIES[name](spark, sf)).split("\n\n")[0]
    assert tree.count("Exchange") == 1
