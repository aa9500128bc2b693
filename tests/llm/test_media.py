"""Copies of images: crops, turns, scales and edits are found, others left alone."""

import numpy as np
import pytest

from graphloom.llm import media
from graphloom.llm.common import table


def picture(seed, h=120, w=140):
    rng = np.random.default_rng(seed)
    a = media.resized(rng.integers(0, 255, (h // 5, w // 5)).astype(np.float32), h, w)
    for _ in range(6):
        y, x = rng.integers(0, h - 20), rng.integers(0, w - 20)
        a[y : y + rng.integers(8, 20), x : x + rng.integers(8, 20)] = rng.integers(0, 255)
    return a


EDITS = {
    "crop": lambda a: a[17:105, 23:121],
    "brighter": lambda a: np.clip(a * 0.8 + 30, 0, 255),
    "turned": lambda a: np.rot90(a),
    "noise": lambda a: np.clip(a + np.random.default_rng(0).normal(0, 2, a.shape), 0, 255),
    "patched": lambda a: np.where((np.arange(a.shape[0])[:, None] < 40) & (np.arange(a.shape[1]) < 40), 128, a),
    "half": lambda a: media.resized(a, a.shape[0] // 2, a.shape[1] // 2),
}


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, media.encode(picture(i))) for i in range(40)]
    rows += [(100 + k, media.encode(f(picture(k)))) for k, f in enumerate(EDITS.values())]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, None), (203, b"no picture"), (204, None), (205, media.encode(np.full((40, 40), 9))), (206, media.encode(np.zeros((3, 3)))), (None, rows[8][1]), (207, b"P5\n9 9\n255\nshort")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "image_id long, image binary, node int, digest string")
    return rows, media.image_copies(df).collect()


def test_edited_copies_are_found(result):
    of = {r.image_id: r.component_id for r in result[1]}
    assert {name: of[100 + k] for k, name in enumerate(EDITS)} == {name: k for k, name in enumerate(EDITS)}


def test_others_are_left_alone(result):
    rows, got = result
    of = {r.image_id: r.component_id for r in got}
    assert len(got) == len(rows) and all(of[i] == i for i in range(40))
    assert of[200] == of[201] == 7 and of[204] == 202 and of[203] == 203 and of[205] == 205 and of[206] == 206 and of[None] is None
    assert {r.n_corners > 0 for r in got if r.image_id in (202, 203, 205, 206)} == {False}


def test_crowd_of_one_picture_is_one_group(spark):
    rng = np.random.default_rng(4)
    a = picture(3)
    rows = [(i, media.encode(np.clip(a + rng.normal(0, 1, a.shape), 0, 255))) for i in range(120)]
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert {r.component_id for r in got} == {0}


def test_links_among_common_corners(spark):
    """Crops of one picture are one group, and so are two copies whose corners 49 unlike pictures have, too."""
    a = picture(3)
    rows = [(i, media.encode(a[i % 7 : 100 + i % 11, i % 8 : 120 + i % 13])) for i in range(60)]
    rng = np.random.default_rng(6)
    letter = np.kron(rng.integers(0, 2, (4, 4)), np.ones((6, 6))) * 255

    def page(at, shade):
        p = np.full((200, 200), 128.0)
        for y, x in at:
            p[y : y + 24, x : x + 24] = letter
        return np.clip(p + shade, 0, 255)

    places = [np.stack([np.arange(6) // 3 * 90 + 15 + rng.integers(0, 50, 6), np.arange(6) % 3 * 60 + 15 + rng.integers(0, 20, 6)], axis=1) for _ in range(50)]
    rows += [(100 + i, media.encode(page(p, 0))) for i, p in enumerate(places)]
    rows.append((200, media.encode(page(places[30] - 3, 0))))
    got = {r.image_id: r for r in media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert {got[i].component_id for i in range(60)} == {0}
    assert got[200].component_id == got[130].component_id


def test_dull_crop_of_a_large_picture(spark):
    a = picture(5, 420, 420)
    a[250:370, 260:380] = 120 + picture(6, 120, 120) / 12
    rows = [(0, media.encode(a)), (1, media.encode(a[255:365, 265:375])), (2, media.encode(picture(9)))]
    got = {r.image_id: r for r in media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert [got[i].component_id for i in range(3)] == [0, 0, 2]


def test_drawn_table(spark):
    d = "/root/testdata/sf0.001"
    assert media.query(spark, d).count() == table(spark, d, "embeddings").count()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [float("nan")]), (4, [0.5]), (5, [None])], "vec_id long, embedding array<float>")
    assert media.image_copies(media.drawn(odd)).count() == 5 and media.image_copies(media.drawn(odd.limit(0))).count() == 0
