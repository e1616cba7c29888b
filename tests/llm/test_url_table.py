"""The labelled URL table: nothing from the data, and held-out names and paths."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadloom.llm import url_table, urls  # noqa: E402


def places(url):
    return re.match(r"https?://([^/?#]*)([^?#]*)", url).groups()


def fitted(spark, rows):
    return urls.fit(spark.createDataFrame([(*places(u), label) for u, _, _, label in rows], "host string, path string, label int"))


@pytest.fixture(scope="module")
def table():
    return url_table.labelled()


def test_no_name_of_the_data_is_in_the_table(spark, table):
    own = {name.split(".")[0] for _, name, _, _ in table}
    for size in ("sf0.001", "sf0.1"):
        found = spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select(urls.host_of(F.col("url")).alias("h")).distinct()
        assert not own & {re.sub(r"^(www|m|blog)\.", "", r.h).split(".")[0] for r in found.collect()}
    assert len(table) <= 10_000 and not any(u.split("/")[2].endswith(("example.com", "example.net", "example.org")) for u, *_ in table)


def test_held_out_names_and_paths(spark, table):
    held = lambda s: sum(map(ord, s)) % 5 == 0
    model = fitted(spark, [r for r in table if not held(r[1]) and not held(r[2])])
    right = {}
    for url, name, path, label in table:
        if held(name) and held(path):
            kind = "clean" if not label else "path" if path in url_table.UNWANTED_PATHS else "host"
            right.setdefault(kind, []).append((model.score(*places(url)) >= 0.5) == bool(label))
    assert all(len(x) >= 50 for x in right.values()), right
    share = {k: sum(x) / len(x) for k, x in right.items()}
    assert share["clean"] >= 0.95 and share["host"] >= 0.9 and share["path"] >= 0.7, share


def test_known_clean_hosts_and_unwanted_paths(spark, table):
    model = fitted(spark, table)
    clean = ("https://www.bbc.co.uk/news", "https://github.com/", "https://postgresql.se/", "https://openstreetmap.fr/")
    assert not {u.split("/")[2].removeprefix("www.") for u in clean} & {name for _, name, _, _ in table}
    assert [u for u in clean if model.score(*places(u)) >= 0.5] == []
    assert model.score("www.somewhere-nice.org", "/free-porn-clips/") >= 0.5 > model.score("www.somewhere-nice.org", "/news/")
