import struct

import numpy as np

from marlspike.operators.graph import major_topics
from marlspike.plans import files
from marlspike.sources import readers


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_lines_and_plays(spark, tmp_path, rows):
    path = write(tmp_path / "p.txt", "1 2 3\n1 2\nx 2 3\n4 5 6")
    assert rows(readers.play_counts(spark, path)) == [(1, 2, 3), (4, 5, 6)]
    assert rows(readers.rejects(spark, path, 3, " ")) == [("1 2",), ("x 2 3",)]
    assert readers.lines(spark, write(tmp_path / "e.txt", "")).count() == 0
    assert rows(readers.artists(spark, write(tmp_path / "a.txt", "1\t A b \nno tab\nx\tC\n2\t"))) == [(1, "A b")]
    assert rows(readers.aliases(spark, write(tmp_path / "s.txt", "\t5\n3\t4\n"))) == [(3, 4)]


def test_csv(spark, tmp_path, rows):
    head = "id_1,id_2,cmp_fname_c1,cmp_fname_c2,cmp_lname_c1,cmp_lname_c2,cmp_sex,cmp_bd,cmp_bm,cmp_by,cmp_plz,is_match\n"
    path = write(tmp_path / "l.csv", head + "1,2,0.5,?,1.0,?,1,1,1,1,?,TRUE\n")
    row = readers.linkage(spark, path).first()
    assert row["cmp_fname_c2"] is None and row["is_match"] is True and row["cmp_plz"] is None
    assert readers.linkage(spark, path, infer=True).first()["cmp_fname_c1"] == 0.5
    assert readers.preview(spark, path).columns[0] == "_c0"
    cover = readers.forest_cover(spark, write(tmp_path / "c.csv", ",".join(["1"] * 54 + ["7"]) + "\n"))
    assert len(cover.columns) == 55 and cover.first()["Cover_Type"] == 7.0
    assert len(readers.connections(spark, write(tmp_path / "k.csv", ",".join(["0"] * 42) + "\n")).columns) == 42


def test_sums_of_times_beyond_a_long(spark, tmp_path):
    """Sums that leave a bigint behind are exact; the others keep the type they have in SQL."""
    n, late = 2_300_000, 4_102_444_799_000
    columns = ["'a' as license", f"{late} as pickuptime", "1000L as dropofftime", *(f"1d as {c}" for c in ("pickupx", "pickupy", "dropoffx", "dropoffy"))]
    spark.range(n).selectExpr(*columns).write.parquet(str(tmp_path / "trips.parquet"))
    found = files.read_trips(spark, str(tmp_path))
    assert n * late > 2**63 and tuple(found.first()) == (n, n * late, n * 1000, float(n))
    assert [t for _, t in found.dtypes] == ["bigint", "decimal(30,0)", "bigint", "double"]
    spark.read.parquet(str(tmp_path / "trips.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "trips.parquet"))
    none = files.read_trips(spark, str(tmp_path / "none"))
    assert tuple(none.first()) == (0, None, None, None) and none.dtypes[1] == ("pickups", "bigint")


def test_records(spark, tmp_path, rows):
    path = write(tmp_path / "m.xml", '<S>\n<MedlineCitation a="1"><DescriptorName MajorTopicYN="Y">A</DescriptorName><DescriptorName MajorTopicYN="N">B</DescriptorName></MedlineCitation>x\n<MedlineCitation><a/></MedlineCitation></S>')
    records = readers.citations(spark, path)
    assert [r[0] for r in records.select(major_topics(records["record"])).collect()] == [["A"], []]
    pages = readers.wiki_pages(spark, write(tmp_path / "w.xml", '<m><page><title>T</title><revision><text bytes="4">Body</text></revision></page></m>'))
    assert rows(pages) == [("T", "Body")]


def test_histories_and_geojson(spark, tmp_path, rows):
    write(tmp_path / "h" / "ABC.csv", "Date,Open,High,Low,Close,Volume\n7-Jan-14,1,1,1,2.5,9\n6-Jan-14,1,1,1,x,9\nbad,1,1,1,1,9\n")
    found = rows(readers.price_histories(spark, str(tmp_path / "h")))
    assert [(s, str(d), c) for s, d, c in found] == [("ABC", "2014-01-07", 2.5)]
    path = write(tmp_path / "g.json", '{"type":"FeatureCollection","features":[{"id":"q","properties":{"borough":"B","boroughCode":3},"geometry":{"type":"Point","coordinates":[1,2]}},{"properties":{},"geometry":null}]}')
    zones = readers.geojson(spark, path)
    first = zones.orderBy("feature_id").first()
    assert first["properties"]["boroughCode"] == "3" and "Point" in first["geometry"]
    texts = [r[0] for r in readers.feature_collection(zones).collect()]
    assert '"id":"q"' in texts[0] and '"geometry":null' in texts[1] and '"id"' not in texts[1]


def test_genome_files(spark, tmp_path, rows):
    gtf = write(tmp_path / "a.gtf", '#!x\nc1\ts\ttranscript\t11\t20\t.\t+\t.\tgene_id "g";\n')
    assert rows(readers.annotations(spark, gtf).select("contig", "feature_type", "start", "end")) == [("c1", "transcript", 10, 20)]
    peaks = write(tmp_path / "a.narrowPeak", "c1\t5\t9\tp\t1.5\t.\t1\t1\t1\t2\n")
    assert rows(readers.narrow_peaks(spark, peaks)) == [("c1", 5, 9, "p", 1.5)]
    assert readers.variants(spark, write(tmp_path / "a.vcf", "##x\n#C\nc1\t3\t.\tA\tG\t.\tPASS\tX\n")).first()["ref"] == "A"
    codes = {"T": 0, "C": 1, "A": 2, "G": 3}
    sequence = "ACGTACG"
    packed = bytearray(2)
    for i, base in enumerate(sequence):
        packed[i // 4] |= codes[base] << (6 - 2 * (i % 4))
    record = struct.pack("<IIII", 7, 1, 2, 2) + struct.pack("<I", 0) + struct.pack("<I", 0) + bytes(packed)
    content = struct.pack("<IIII", 0x1A412743, 0, 1, 0) + b"\x02c1" + struct.pack("<I", 16 + 3 + 4) + record
    assert rows(readers.two_bit(spark, write(tmp_path / "g.2bit", content))) == [("c1", "ACNNACG")]


def test_frames_and_parquet(spark, tmp_path, rows):
    frame = np.arange(6, dtype=np.float16).reshape(3, 2, 1)
    write(tmp_path / "f" / "t-004.bin", frame.tobytes(order="F"))
    cells = readers.image_stack(spark, str(tmp_path / "f"), (3, 2, 1))
    assert rows(cells.where("x = 2 and y = 1")) == [(4, 2, 1, 0, 5.0)]
    readers.write_parquet(cells, str(tmp_path / "out"), ["x"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert readers.numbers(spark, 5, 3, 2).agg({"id": "sum"}).first()[0] == 18
    assert readers.stop_words(write(tmp_path / "s.txt", "a\n\nthe \n")) == ["a", "the"]
