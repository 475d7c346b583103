import pytest
from pyspark.sql import functions as F

from tracklake.functions import color as C
from tracklake.functions import geometry as G
from tracklake.functions import probability as P
from tracklake.functions import text as T
from tracklake.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def test_iou(spark):
    assert one(spark, G.iou(lits(0, 0, 10, 10), lits(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, G.iou(lits(0, 0, 0, 0), lits(0, 0, 0, 0))) == 0
    assert one(spark, G.iou(lits(0, 0, 1, 1), lits(2, 2, 3, 3))) == 0


def test_interval_iou(spark):
    assert one(spark, G.interval_iou(*lits(0, 4, 2, 6))) == pytest.approx(1 / 3)
    assert one(spark, G.interval_iou(*lits(1, 1, 1, 1))) == 0


def test_clip_keeps_last_pixel(spark):
    assert one(spark, F.array(*G.clip_to_frame(lits(-5, 3, 2000, 900), 1280, 720))) == [0, 3, 1279, 719]


def test_cosine_guards(spark):
    a, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1)
    assert one(spark, V.cosine(a, zero)) == 0
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, V.l2_normalize(a)) == pytest.approx([0.6, 0.8])


def test_distributions(spark):
    m = F.create_map(F.lit("a"), F.lit(0.6), F.lit("b"), F.lit(0.39), F.lit("c"), F.lit(0.01))
    assert one(spark, P.drop_tail(m)) == pytest.approx({"a": 0.6 / 0.99, "b": 0.39 / 0.99})
    none = F.array(F.lit("z"))
    assert one(spark, P.keep_known(m, none, empty_if_none=True)) == {}
    assert set(one(spark, P.keep_known(m, none, empty_if_none=False))) == {"a", "b", "c"}
    assert one(spark, P.merge_max(m, F.create_map(F.lit("c"), F.lit(0.5))))["c"] == 0.5


def test_position_prior(spark):
    assert one(spark, P.position_prior(F.lit("GK"), F.lit(1.0), F.lit(40.0))) == pytest.approx(0.5 - 0.0048)
    assert one(spark, P.position_prior(F.lit(None).cast("string"), F.lit(1.0), F.lit(40.0))) == 0.5


@pytest.mark.parametrize("raw, want", [(" 9.0 ", "9"), ("", None), ("10", "10"), (None, None)])
def test_number(spark, raw, want):
    assert one(spark, T.normalize_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("10 Kylian Mbappé", ("10", "Kylian Mbappe", True, "player")),
        ("Goalkeeper 23 Emiliano", ("23", "Emiliano", True, "goalkeeper")),
        ("for tracker 4 Álvarez", ("4", "Alvarez", False, "player")),
        ("referee", (None, "Referee", False, "referee")),
        ("Player-Detection", (None, None, False, "root")),
    ],
)
def test_category(spark, raw, want):
    assert tuple(one(spark, T.parse_category(F.lit(raw)))) == want


def test_names(spark):
    assert one(spark, T.slug(F.lit("Álvarez  Núñez!"))) == "alvarez_nunez"
    assert one(spark, T.player_key(F.lit("A/B"), F.lit("x"), F.lit(None).cast("string"))) == "A_B|x|NA"
    assert one(spark, T.frame_of_file(F.lit("a_mp4-0007_jpg.x"))) == 210
    assert one(spark, T.frame_of_file(F.lit("other"))) == -1
    assert one(spark, T.digit_runs(F.lit("a12b3"))) == ["12", "3"]


def test_colours(spark):
    assert one(spark, C.parse_hex(F.lit("#ff0010"))) == [255, 0, 16]
    with pytest.raises(Exception):
        one(spark, C.parse_hex(F.lit("nope")))
    assert one(spark, C.hue_distance(F.lit(5), F.lit(175))) == 10
    rgb = (F.lit(0), F.lit(255), F.lit(0))
    assert one(spark, F.array(*C.hsv(rgb))) == [60, 255, 255]
    assert one(spark, C.kit_distance(rgb, rgb)) == 0


def test_accents_take_one_pass_over_a_text(spark):
    t = spark.createDataFrame([("Dvořák é 한",), ("plain",), (None,)], "t string").select(T.strip_accents(F.col("t")).alias("p"))
    assert [r["p"] for r in t.collect()] == ["Dvorak e 한", "plain", None]
    # a class of all marks looks through hundreds of ranges for each character
    assert "regexp_replace" not in t._jdf.queryExecution().optimizedPlan().toString().lower()
