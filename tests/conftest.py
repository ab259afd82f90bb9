from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"

GARDEN = [
    "Every spring morning the gardener waters nine narrow rows of tomatoes behind the stone cottage.",
    "Her neighbour keeps bees and sells jars of dark honey beside the village road.",
    "Children walking home along the village road often stop to count bees near the lavender.",
    "An old iron gate separates the orchard from meadows where sheep graze through late autumn evenings.",
    "By winter the gardener keeps nine lemon trees warm behind the stone wall of the greenhouse.",
]

# Sentences 1 and 2 hold as many terms, all of them seen nowhere else: their scores tie.
HARBOUR = [
    "Fishing boats leave the harbour before sunrise whenever calm weather lets small crews work.",
    "Painters repair weathered hulls using copper brushes, linen rags, turpentine, varnish and patience.",
    "Merchants weigh silver herring against brass counterweights, scribbling prices inside thick ledgers nightly.",
    "Gulls circle noisily above the harbour cranes while small crews stack empty barrels, ropes, nets and lanterns near slippery steps.",
    "At dusk a lighthouse keeper climbs ninety stairs, trims both wicks, polishes curved lenses and records passing fishing boats.",
]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from precis.session import RECOMMENDED_CONF

    b = (
        SparkSession.builder.master("local[*]")
        .appName("precis-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def docs_df(spark):
    def make(texts: dict[int, str]):
        return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")

    return make
