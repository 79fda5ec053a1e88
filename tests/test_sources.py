import os

import pytest
from pyspark.sql import functions as F

from leadloom.sources import contact_files as CF
from leadloom.sources import feeds as FD
from leadloom.sources import sinks as SK

# "Name" and "full_name" are no keywords of the name column, so those files have no names.
HEADERS = [
    "Họ Tên,Số ĐT,Email,Địa Chỉ,Nguồn,Ghi Chú", "Name,Phone,Email,Address,Source,X", "KHÁCH HÀNG,ĐIỆN THOẠI,EMAIL,TỈNH/THÀNH",
    "họ và tên,số điện thoại,email,nguồn dữ liệu", "full_name,mobile,email,location,channel", "Tên,SĐT,Email",
]


@pytest.mark.parametrize("split", ["128MB", "200b"])
def test_contact_csv(spark, tmp_path, split):
    os.makedirs(tmp_path / "sub")
    for i, header in enumerate(HEADERS):
        lines = (["DANH SACH,,,", ""] if i % 2 else []) + [header] + [f'"Le, {n}",09{i}000{n:04d},u{n}@x.vn' for n in range(40)]
        (tmp_path / "sub" / f"f{i}.csv").write_bytes(("﻿" + "\r\n".join(lines) + "\r\n").encode())
    (tmp_path / "latin.csv").write_bytes("Full Name,Phone,Email\nÉtienne,0912345678,e@x.vn\n".encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = CF.read_contact_csv(spark, str(tmp_path)).select("file", "raw_name", "raw_phone", "raw_email").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"].rsplit("/", 1)[-1], set()).add((r["raw_name"], r["raw_phone"], r["raw_email"]))
    assert by_file.pop("latin.csv") == {("Étienne", "0912345678", "e@x.vn")}
    for i in range(len(HEADERS)):
        want = {(f"Le, {n}" if i not in (1, 4) else None, f"09{i}000{n:04d}", f"u{n}@x.vn") for n in range(40)}
        assert by_file[f"f{i}.csv"] == want, HEADERS[i]


@pytest.mark.parametrize("columns", [34, 48])
def test_wide_files_quoted_breaks_and_encodings(spark, tmp_path, columns):
    """Contact columns far to the right, line breaks in quoted cells, UTF-16 and latin-1 files."""
    header = [f"Field {i}" for i in range(columns)]
    header[0], header[columns - 2], header[columns - 1] = "Full Name", "Mobile Phone", "Email"
    rows = [["Le \"Anh\"\nVan, A", *[""] * (columns - 3), f"091234567{n}", f"u{n}@x.vn"] for n in range(3)]
    quote = lambda x: '"' + x.replace('"', '""') + '"' if x else ""
    text = "\r\n".join([",".join(header), *[",".join(map(quote, r)) for r in rows]]) + "\r\n"
    flat = text.replace("\n\"\"", "").replace("\"\"\nVan", "\"\" Van")
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(flat.encode("utf-16"))
    (tmp_path / "c.csv").write_bytes(flat.replace("Van", "Vân").encode("latin-1"))
    (tmp_path / "d.csv").write_bytes(f"Full Name,Phone\n5\" pipe,0912345678\nNext,0912345679\n".encode())
    got = {}
    for r in CF.read_contact_csv(spark, str(tmp_path)).collect():
        got.setdefault(r["file"][-5:], set()).add((r["raw_name"], r["raw_phone"], r["raw_email"]))
    want = lambda name: {(name, f"091234567{n}", f"u{n}@x.vn") for n in range(3)}
    assert got["a.csv"] == want('Le "Anh"\nVan, A') and got["b.csv"] == want('Le "Anh" Van, A') and got["c.csv"] == want('Le "Anh" Vân, A')
    assert got["d.csv"] == {('5" pipe', "0912345678", None), ("Next", "0912345679", None)}


def test_first_and_last_name_columns(spark):
    headers = spark.createDataFrame([("a", ["first name", "last name", "phone number", "mobile phone"])], "file STRING, cells ARRAY<STRING>")
    row = CF.map_columns(headers).first()
    assert (row["i_name"], row["i_phone"], row["i_email"]) == (0, 2, None)


def test_text_files(spark, tmp_path):
    (tmp_path / "phones.txt").write_text("0912345678\n\n  0987654321 \n")
    (tmp_path / "social.txt").write_text("100012345678901 Nguyen Van An Dep 0912345678 a@b.vn vi_VN\n123456789 +84987654321 https://x.y Le\nonly\n")
    lines = CF.read_lines(spark, str(tmp_path))
    assert {r["raw_phone"] for r in CF.plain_phone_files(lines).collect()} == {"0912345678", "0987654321"}
    got = {(r["uid"], r["phone"], r["email"], r["name"], r["link"]) for r in CF.read_social_txt(spark, str(tmp_path)).collect()}
    assert got == {("100012345678901", "0912345678", "a@b.vn", "Nguyen Van An", "https://facebook.com/100012345678901"),
                   ("123456789", "+84987654321", "", "Le", "https://facebook.com/123456789")}


def test_listing_and_documents(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x")
    (tmp_path / "b.pdf").write_text("x")
    (tmp_path / "c.doc").write_bytes(b"\xff\x00call 0912345678 or +84987654321\xfe")
    listed = CF.file_listing(spark, str(tmp_path))
    assert [r["file_name"] for r in listed.collect()] == ["a.CSV", "c.doc"]
    docs = spark.read.format("binaryFile").load(str(tmp_path / "c.doc"))
    assert [r["phone"] for r in CF.phones_in_content(docs, "path").orderBy("pos").collect()] == ["0912345678", "+84987654321"]


def test_lead_count_and_payloads(spark):
    rows = spark.createDataFrame([(5, [("lead", 9)]), (None, [("click", 1), ("lead", 9)]), (None, [("click", 1)]), (None, None)],
                                 "leads BIGINT, actions ARRAY<STRUCT<action_type: STRING, value: BIGINT>>")
    assert [r[0] for r in rows.select(FD.lead_count(F.col("leads"), F.col("actions"))).collect()] == [5, 9, 0, 0]


def test_audience_can_hash_keys(spark):
    lead = spark.createDataFrame([("a@b.vn", "0912345678", "Le Van An", "TP. Hồ Chí Minh", 10, "f")],
                                 "email STRING, phone STRING, name STRING, province STRING, score INT, file_source STRING")
    plain, hashed = SK.audience(lead).first(), SK.audience(lead, hash_keys=True).first()
    assert (plain["phone"], plain["fn"], plain["ln"], plain["ct"], plain["country"]) == ("84912345678", "An", "Le Van", "Hồ Chí Minh", "VN")
    assert len(hashed["phone"]) == 64 and hashed["fn"] == "An"


def test_landed_insights_are_compressed(spark, monkeypatch, tmp_path):
    """The landed JSON is the most that the query writes: its files are compressed, and all rows come back."""
    import glob

    from leadloom.plans import files as PF

    monkeypatch.setattr(PF, "new_dir", lambda *a: f"{tmp_path}/insights")
    leads = PF.src8_insights_json(spark, "/root/testdata/sf0.001").agg({"leads": "sum"}).first()[0]
    found = glob.glob(f"{tmp_path}/insights/part-*")
    assert found and all(f.endswith(".json.gz") for f in found)
    assert leads == PF.PA.insights(spark, "/root/testdata/sf0.001").agg({"leads": "sum"}).first()[0]
