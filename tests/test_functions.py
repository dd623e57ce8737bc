"""Functions on fixed vectors and by property."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.functions import blake3, content, detect, geometry, imaging, rank, text, vectors
from papyrine.functions import markup as M
from papyrine.schema import PARTS

MARKUP = [
    ("<rdf><label>life &amp; substance</label></rdf>", "life & substance"),
    ("<p>&amp;lt;tag&amp;gt; &lt;real&gt;</p>", "&lt;tag&gt; <real>"),
    ("<p title=\"a>b\">first</p><p title='c>d'>second</p>", "first second"),
    ('<style>.x{}</style><p>visible <![CDATA[<text>]]></p><SCRIPT>var x="</p>";</SCRIPT>', "visible <text>"),
    ("<p>&nbsp; text &nbsp;</p>", "text"),
    ("a<!-- x -->b", "ab"), ("&copy;", "&copy;"), ("a<script>b", "a"), ("<script/>x", "x"), ("&#38;lt;", "&lt;"), ("&#x41;b", "Ab"),
    ("<svg:style>q</svg:style>z", "z"), ("a <!-- <script> --> b", "a b"), ("<?pi x?>a<!DOCTYPE html>b", "ab"), ("", ""), ("a & b", "a & b"), ("<!DOCTYPE x [<!ENTITY a '>'>]>t", "t"),
]


def test_markup_vectors(spark):
    df = spark.createDataFrame([*MARKUP, (None, None)], "s string, want string")
    for r in df.select("s", "want", M.markup_text(F.col("s")).alias("m")).collect():
        assert r.m.text == r.want, r.s
        assert r.m.fault is None


def test_markup_faults(spark):
    bad = ["a<b", "<!-- x", "&#0;", "&#xZZ;", "<![CDATA[x", "<!x>", "<?pi"]
    df = spark.createDataFrame([(b,) for b in bad], "s string").select(M.markup_text(F.col("s")).alias("m"))
    assert all(r.m.text is None and r.m.fault for r in df.collect())


_pieces = st.lists(st.sampled_from(["<p>", "</p>", "<br/>", "<a b='>'>", "<script>", "</script>", "<style x=1>", "</style >", "<!-- c -->", "x", " ", "&amp;", "&lt;", "&zz;", "&", " ", "é", "<!doctype html>"]), max_size=12)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_pieces, min_size=60, max_size=60))
def test_markup_paths_agree(spark, many):
    texts = ["".join(p) for p in many]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", M.needs_tokenizer(F.col("s")).alias("odd"), M.fast_text(F.col("s")).alias("fast")).collect():
        if not r.odd:
            assert r.fast == M.visible_text(r.s), r.s


def test_canonical_text(spark):
    rows = [(None, [], None), ("canonical", ["part"], "canonical"), ("", ["part"], ""), (None, [None, "", None], None), (None, ["", None, ""], "\n\n"), (None, [" "], " "), (None, ["", "text", ""], "\n\ntext\n\n"), (None, ["first", "second"], "first\n\nsecond")]
    df = spark.createDataFrame(rows, "c string, p array<string>, want string")
    parts = F.transform("p", lambda t, i: content.part(i.cast("bigint"), F.lit("text"), t)).cast(PARTS)
    for r in df.select("want", content.canonical_text(F.col("c"), parts).alias("got"), content.has_text(F.col("c"), parts).alias("has")).collect():
        assert r.got == r.want
        assert r.has == (r.want is not None)


def test_blank_parts_and_json(spark):
    df = spark.createDataFrame([(["a", "  ", None, "b"],)], "p array<string>")
    parts = F.transform("p", lambda t, i: content.part(i.cast("bigint"), F.lit("text"), t))
    r = df.select(content.without_blank_parts(parts).alias("k"), content.as_json(content.part(F.lit(0), F.lit("text"), F.lit("x"))).alias("j")).first()
    assert [(p["index"], p["text"]) for p in r.k] == [(0, "a"), (1, "b")]
    assert r.j == '{"index":0,"kind":"text","text":"x"}'


def test_paths_and_rules(spark):
    rows = [("/a/b.tar.gz", "b.tar", "gz"), (".bashrc", ".bashrc", None), ("foo.", "foo", ""), ("x", "x", None), (None, None, None), ("/a/.b.MD", ".b", "MD")]
    df = spark.createDataFrame(rows, "p string, stem string, ext string").withColumn("c", F.lit("x").cast("binary"))
    for r in df.select("p", "stem", "ext", detect.stem_of(F.col("p")).alias("s"), detect.extension_of(F.col("p")).alias("e"), detect.extension_label(detect.extension_of(F.col("p")), F.col("c")).alias("l")).collect():
        assert (r.s, r.e) == (r.stem, r.ext), r.p
        assert r.l == ("markdown" if r.ext == "MD" else None)
    bad = spark.createDataFrame([(bytearray(b"x\xff"),)], "c binary").select(detect.extension_label(F.lit("md"), F.col("c")).alias("l"), detect.signature_label(F.col("c")).alias("s")).first()
    assert (bad.l, bad.s) == (None, "unknown")


def test_scores_to_labels(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.6, 0.1, 0.0, 0.6],), ([float("nan"), 1.0],), ([1.1],), ([-0.1],), ([float("inf")],), ([],)], "s array<double>")
    got = [r.b for r in df.select(detect.argmax(F.col("s")).alias("b")).collect()]
    assert (got[0]["index"], got[0].valid) == (2, True)
    assert not any(b.valid for b in got[1:])
    r = spark.range(1).select(detect.decided(F.lit("html"), F.lit(0.1), F.lit(0.5)).alias("a"), detect.decided(F.lit("pdf"), F.lit(0.1), F.lit(0.5)).alias("b"), detect.decided(F.lit("pdf"), F.lit(0.9), F.lit(0.5), {"pdf": "doc"}).alias("c")).first()
    assert tuple(r) == ("txt", "unknown", "doc")


def test_edges_features_brand(spark):
    df = spark.createDataFrame([(bytearray(b"aa-bb"),), (bytearray(b"aabb"),), (bytearray(b"\x00\x00\x00\x18ftypheic\x00"),), (bytearray(b""),)], "c binary")
    got = df.select(detect.edge_sample(F.col("c"), 2).alias("e"), detect.has_heif_brand(F.col("c")).alias("h"), detect.features(4, 3, 3)(F.col("c")).alias("f"), detect.short_label(F.col("c"), detect.features(4, 3, 3)(F.col("c")), 3).alias("s")).collect()
    assert [bytes(r.e) for r in got[:2]] == [b"aabb", b"aabb"]
    assert [r.h for r in got] == [False, False, True, False]
    assert got[0].f == [97, 97, 45, 45, 98, 98]
    assert got[3].f is None
    assert [r.s for r in got] == [None, None, None, "empty"]


# Published vectors: input bytes count 0 to 250 round and round.
HASHES = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
}


def test_blake3(spark):
    data = {n: bytes(i % 251 for i in range(n)) for n in HASHES}
    assert blake3.hashes(list(data.values())) == list(HASHES.values())
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "c binary").select(blake3.blake3_hex(F.col("c")).alias("h"))
    assert [r.h for r in df.collect()] == ["6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", None]


def test_rank(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, -2.0)], "i int, s double")
    assert [r.i for r in rank.top_k(df, "s", "i", 3).collect()] == [1, 2, 0]
    with pytest.raises(ValueError, match="top_k"):
        rank.top_k(df, "s", "i", 0)
    assert (rank.resolved_batch(128), rank.resolved_batch(4), rank.resolved_batch(0, 0)) == (32, 4, 0)
    with pytest.raises(ValueError, match="batch_size"):
        rank.resolved_batch(3, 0)
    wide = spark.createDataFrame([(1000.0,), (-1000.0,), (0.0,)], "x double").select(rank.sigmoid(F.col("x")).alias("y"))
    assert [r.y for r in wide.collect()] == [1.0, 0.0, 0.5]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "a array<float>, z array<float>, t array<array<float>>, m array<int>").select(
        vectors.l2_normalised(F.col("a")).alias("n"), vectors.l2_normalised(F.col("z")).alias("z"), vectors.mean_pooled(F.col("t"), F.col("m")).alias("p"), vectors.cls_pooled(F.col("t")).alias("c"), vectors.position_ids(F.col("m"), 1).alias("i")
    ).first()
    assert (np.allclose(r.n, [0.6, 0.8]), r.z, r.p, r.c, r.i) == (True, [0.0, 0.0], [2.0, 3.0], [1.0, 2.0], [2, 3, 1])
    b = vectors.relative_buckets(300)
    assert (b[0, 0], b[5, 0], b[0, 5], b.max(), b[299, 0]) == (0, 5, 21, 31, 15)


def test_text_similarity(spark):
    df = spark.createDataFrame([("A  b", "a b", 1.0), ("", " ", 1.0), ("abcd", "abxd", 0.75), (None, "a", None)], "a string, b string, want double")
    assert [r.got for r in df.select(text.similarity(F.col("a"), F.col("b")).alias("got")).collect()] == [1.0, 1.0, 0.75, None]


def test_reading_order_and_ctc(spark):
    boxes = np.array([[1, 1, 4, 3], [1, 1, 3, 3], [50, 0, 60, 9], [5, 8, 10, 20]], float)
    assert geometry.reading_order(boxes) == [1, 0, 3, 2]
    logits = np.array([[0.90, 0.05, 0.05], [0.05, 0.90, 0.05], [0.10, 0.80, 0.10], [0.90, 0.05, 0.05], [0.10, 0.80, 0.10], [0.10, 0.10, 0.80], [0.10, 0.80, 0.80]])
    for x in (logits, logits.T):
        best, top = geometry.ctc_best(x, 3)
        df = spark.createDataFrame([(best.tolist(), top.tolist())], "i array<int>, s array<double>")
        o = df.select(geometry.ctc_text(F.col("i"), F.col("s"), F.array(F.lit("a"), F.lit("b"))).alias("o")).first().o
        assert o.text == "aaba"
        assert abs(o.confidence - 0.825) < 1e-6


def test_components_boxes_overlap():
    m = np.zeros((40, 40), np.float32)
    m[5:15, 5:25] = 0.9
    m[20:24, 2:4] = 0.9
    m[30:36, 30:36] = 0.25
    assert [c[:5] for c in geometry.components(m, 0.2)] == [(5, 5, 25, 15, 200), (2, 20, 4, 24, 8), (30, 30, 36, 36, 36)]
    boxes = geometry.text_boxes(m, 80, 40)
    by = 200 * 1.4 / 60
    assert np.allclose(boxes, [[(5 - by) * 2, 5 - by, (25 + by) * 2, 15 + by]], atol=1e-4)
    a = np.array([[0, 0, 2, 2], [1, 1, 3, 3], [5, 5, 6, 6]], float)
    assert np.allclose(geometry.overlaps(a[0], a), [1, 1 / 7, 0])
    assert geometry.suppressed(a, 0.1) == [0, 2]
    assert geometry.suppressed(a, None) == [0, 1, 2]
    assert geometry.matched(a, a[::-1]) == [(0, 2, 1.0), (1, 1, 1.0), (2, 0, 1.0)]


def test_components_match_flood_fill():
    rng = np.random.default_rng(3)
    m = (rng.random((30, 30)) > 0.5).astype(np.float32)
    seen, sizes = np.zeros_like(m, bool), []
    for y in range(30):
        for x in range(30):
            if m[y, x] and not seen[y, x]:
                stack, n = [(y, x)], 0
                seen[y, x] = True
                while stack:
                    a, b = stack.pop()
                    n += 1
                    for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                        if 0 <= c < 30 and 0 <= d < 30 and m[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
                sizes.append(n)
    assert [c[4] for c in geometry.components(m, 0.5)] == sizes


def test_order_ranks_anchors_positions():
    f = np.array([[0, 0, 1, 0], [1, 0, 0, 0], [0, 1, 0, 0]], float)
    assert geometry.order_ranks(f).tolist() == [1, 0, 2]
    a, good = geometry.anchors([(2, 2), (200, 1)])
    assert a.shape == (204, 4)
    assert good[:4].all()
    assert np.isinf(a[4]).all()
    p = geometry.position_table(2, 3)
    assert p.shape == (6, 256)
    assert p[0, 64] == 1.0


def test_dictionary():
    y = "Global:\n  a: 1\nPostProcess:\n  name: x\n  character_dict:\n  - '''' \n  - \"\\\"\"\n  - a # no\n  - '#'\nNext:\n  - z\n"
    assert geometry.character_dictionary(y) == ["'", '"', "a", "#", " "]
    assert geometry.character_dictionary("PostProcess:\n  character_dict: ['a', b]\n") == ["a", "b", " "]
    with pytest.raises(ValueError, match="character_dict"):
        geometry.character_dictionary("x: 1")


def source() -> np.ndarray:
    x, y = np.meshgrid(np.arange(17), np.arange(13))
    return np.stack([37 * x + 11 * y, 5 * x + 53 * y, 7 + 17 * x + 29 * y], axis=2).astype(np.uint8)


# The source above, resized to 8 by 6 by a widely used image library, both ways.
LINEAR = """
27 34 33 106 44 69 184 55 105 23 65 142 86 76 178 164 87 214 163 97 101 65 108 30 51 148 96 130 159 132 208 170 168 47 180 204
109 191 229 188 201 73 55 212 57 89 223 93 75 29 159 153 39 195 232 50 231 55 61 47 133 50 48 212 60 84 35 71 120 113 82 156
99 122 210 177 133 75 48 143 38 78 154 74 157 165 110 188 175 146 58 186 183 137 196 219 122 173 29 201 184 65 60 194 101 102 25 137
181 23 173 159 34 209 82 45 181 161 55 26 146 96 91 225 106 128 48 117 164 126 128 200 205 138 229 27 149 16 106 160 52 185 170 88
"""
CUBIC = """
23 28 29 103 39 66 182 50 102 18 60 139 86 71 176 165 82 220 168 93 82 68 103 18 47 146 93 128 157 130 204 167 166 44 178 202
110 217 255 194 226 67 31 237 57 92 248 93 71 22 156 152 33 194 254 44 241 53 55 41 134 46 46 219 58 84 7 68 120 116 79 157
95 123 212 176 134 63 28 145 36 78 157 75 158 168 112 193 178 148 62 189 184 141 200 223 120 181 17 207 192 66 54 203 102 102 0 138
183 0 175 166 10 223 84 20 194 165 31 0 144 100 93 253 111 130 41 122 166 126 133 202 208 144 235 7 154 0 109 165 59 189 176 93
"""


def test_resize_is_byte_exact():
    assert imaging.resize_linear(source(), 8, 6).ravel().tolist() == [int(x) for x in LINEAR.split()]
    assert imaging.resize_cubic(source(), 8, 6).ravel().tolist() == [int(x) for x in CUBIC.split()]


def test_images():
    assert (imaging.decode_png(imaging.encode_png(source())) == source()).all()
    with pytest.raises(ValueError, match="PNG"):
        imaging.decode_png(b"x")
    assert imaging.detector_size(100, 200) == (736, 1472)
    assert imaging.detector_size(1, 10000) == (32, 4000)
    tall = np.zeros((4, 2, 3), np.uint8)
    tall[0, 1, 0] = 255
    out = imaging.crop(tall, np.array([[0, 0], [2, 0], [2, 4], [0, 4]]))
    assert out.shape == (2, 4, 3)
    assert out[0, 0, 0] == 255
    with pytest.raises(ValueError, match="area"):
        imaging.crop(tall, np.zeros((4, 2)))
    assert imaging.recogniser_input(source()).shape == (3, 48, 320)
    assert imaging.layout_input(source()).shape == (3, 800, 800)


def test_markup_of_large_scripts_takes_linear_time(spark):
    import time

    def seconds(n):
        d = spark.createDataFrame([("<p>a</p><script>" + "x<" * n + "</script>b",)], "h string")
        began = time.perf_counter()
        assert d.select(M.markup_text(F.col("h"))["text"].alias("t")).first().t == "a b"
        return time.perf_counter() - began

    seconds(10)
    assert seconds(400_000) < 30
