"""Quantised vectors against exact arithmetic."""

from bytespan import queries

#: A vector's largest component and one whose code differs if the scale is rounded to nine places first.
CASES = [(-0.2756553292274475, 0.15302126109600067, 70), (0.3075942099094391, -0.1683291345834732, -70), (0.36802369356155396, 0.1434422880411148, 49)]


def test_codes_take_the_exact_scale(spark, tmp_path):
    rows = [(i, [most, x]) for i, (most, x, _) in enumerate(CASES)] + [(9, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["scale"], r["codes"]) for r in queries.QUERIES["quantize_vectors"](spark, str(tmp_path)).collect()}
    assert got == {i: (round(abs(most) / 127, 9), f"{127 if most > 0 else -127},{code}") for i, (most, _, code) in enumerate(CASES)} | {9: (0.0, "0,0")}
