import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipweave.config import Config, from_dict
from dipweave.functions import numbers, stars, text
from dipweave.functions.epochs import common_time
from dipweave.operators.lookup import lookup
from dipweave.operators.medians import exact_quantile


@pytest.mark.parametrize(("spelling", "name"), [("KIC 1234", "KIC 1234"), ("kic001234", "KIC 1234"), (" Tic - 7 ", "TIC 7"), ("EPIC_020", "EPIC 20"), ("TIC 000", "TIC 0"), ("TIC", None), ("unknown", None), ("", None), (None, None), ("KIC 12a", None), ("KIC 1 2", None)])
def test_designation(rows, spelling, name):
    assert rows([(spelling,)], "s string").select(stars.designation(F.col("s"))).first()[0] == name


def test_same_star_through_the_catalogue(rows):
    links = stars.catalog_links(rows([(5, 9), (6, 9), (6, 9), (7, None), (None, 3)], "tic_id bigint, kic bigint"))
    names = rows([("TIC 5",), ("TIC 6",), ("KIC 9",), ("TIC 9",), (None,)], "designation string")
    got = {r["designation"]: r["star"] for r in stars.star_keys(names, links).collect()}
    assert got == {"TIC 5": "KIC 9", "TIC 6": "KIC 9", "KIC 9": "KIC 9", "TIC 9": "TIC 9"}


def test_missing_and_infinite(rows):
    df = rows([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.is_finite(F.col("x"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(numbers.known(F.col("x"))).collect()] == [1.0, None, math.inf, -math.inf, None]


def test_text(rows):
    df = rows([("KIC 12/3\\4", " kic 0042 ", "Sector 07", "12 30 00", "-05:30:00", "187.5", "x")], "a string, b string, c string, ra string, dec string, deg string, bad string")
    got = df.select(text.slug(F.col("a")), text.file_name(F.col("a")), text.kic_number(F.col("b")), text.last_number(F.col("c")), text.angle(F.col("ra"), True), text.angle(F.col("dec"), False), text.angle(F.col("deg"), True), text.angle(F.col("bad"), True), text.kic_number(F.lit("TIC 42"))).first()
    assert list(got) == ["kic-12-3-4", "KIC_12_3_4", 42, 7, 187.5, -5.5, 187.5, None, None]
    assert rows([("00 04 20.33", "-29 16 07.7")], "a string, b string").select(F.round(text.angle(F.col("a"), True), 4), F.round(text.angle(F.col("b"), False), 4)).first()[:] == (1.0847, -29.2688)


def test_epochs(rows):
    df = rows([(10.0, "TESS"), (10.0, " kepler"), (10.0, "other"), (math.nan, "K2"), (None, "K2")], "t double, m string")
    assert [r[0] for r in df.select(common_time(F.col("t"), F.col("m"))).collect()] == [2177.0, 10.0, None, None, None]


@pytest.mark.parametrize("q", [0.5, 0.99, 0.0, 1.0])
def test_exact_quantile(rows, q):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=501), "b": np.exp(rng.normal(size=400) * 5), "c": np.array([3.0]), "d": np.repeat([1.0, 2.0], 5), "e": -np.exp(rng.normal(size=10))}
    table = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("a", math.nan), ("z", None)]
    got = {r["k"]: r["m"] for r in exact_quantile(rows(table, "k string, v double"), "k", "v", q, "m").collect()}
    assert got.keys() == data.keys()
    for k, v in data.items():
        assert got[k] == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_lookup_keeps_every_row_of_a_hot_key(rows):
    table = rows([(n, "hot" if n % 3 == 0 else f"k{n}" if n % 3 == 1 else None) for n in range(300)], "id bigint, key string")
    values = rows([("hot", 1), ("k1", 2), ("none", 3)], "key string, v int")
    got = {r["id"]: r["v"] for r in lookup(table, values, "key", "id").collect()}
    assert len(got) == 300 and all(got[n] == (1 if n % 3 == 0 else 2 if n == 1 else None) for n in range(300))
    assert lookup(table.limit(0), values, "key", "id").count() == 0


def test_config():
    assert from_dict({"candidates": {"sigma_threshold": 5.0}}).candidates.sigma_threshold == 5.0
    assert from_dict(Config().to_dict()) == Config()
    with pytest.raises(ValueError):
        from_dict({"candidates": {"x": 1}})
    with pytest.raises(ValueError):
        from_dict({"x": {}})
    with pytest.raises(TypeError):
        from_dict({"candidates": 3})
