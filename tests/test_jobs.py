from pyspark.sql import functions as F

from leadloom import jobs
from leadloom.plans.views import load
from leadloom.store import ContactStore


def test_three_phases(spark, tmp_path):
    inbox, data = tmp_path / "inbox", str(tmp_path / "data")
    for folder in ("csv", "txt"):
        (inbox / folder).mkdir(parents=True)
    (inbox / "csv" / "Vinhomes.csv").write_text("Name,Phone,Email,Address\n" + "\n".join(f"Lead {i},09100{i:05d},l{i}@x.vn,Hà Nội" for i in range(30)) + "\nLead 0,0910000000,,\nBad,123,,\n")
    (inbox / "txt" / "list.txt").write_text("\n".join(f"09100{i:05d}" for i in range(20, 40)))
    first = jobs.ingest(spark, str(inbox), data, "2024-01-01")
    assert first["contacts"].count() == 40
    total = first["stats"].filter("file_name IS NULL").first()
    assert (total["valid"], total["duplicate"], total["invalid_phone"]) == (40, 11, 1)
    second = jobs.ingest(spark, str(inbox), data, "2024-01-02")
    assert second["contacts"].count() == 40
    assert second["stats"].filter("file_name IS NULL").first()["valid"] == 0
    sf = "/root/testdata/sf0.001"
    hot = jobs.enrich(spark, data, load(spark, sf, "v_interactions"), load(spark, sf, "v_listings"), "2024-01-31")
    assert hot["hot_leads"].count() > 0 and hot["profiles"].count() > 40
    calls = jobs.score(spark, data, "2024-01-31")
    assert calls.count() == hot["profiles"].count()
    assert calls.filter(F.col("cluster").isNull() | (F.col("lead_score") > 10)).count() == 0


def contacts_of(spark, data, run):
    return sorted(map(str, ContactStore(spark, f"{data}/contacts").contacts(run).collect()))


def test_runs_can_be_repeated_and_come_late(spark, tmp_path):
    boxes = {}
    for day, names in (("2024-01-01", "abc"), ("2024-01-02", "cd"), ("2024-01-03", "ae")):
        boxes[day] = tmp_path / day
        for folder in ("csv", "txt", "documents", "identities"):
            (boxes[day] / folder).mkdir(parents=True)
        (boxes[day] / "csv" / f"{day}.csv").write_text("Full Name,Phone,Email\n" + "\n".join(f"{n} {day},091234567{ord(n) % 10},{n}@x.vn" for n in names) + "\nBad,12,\n")
        (boxes[day] / "txt" / f"{day}.txt").write_text("0987654321\n")
        (boxes[day] / "documents" / f"{day}.doc").write_bytes(b"\xff call 0977000111 now")
        (boxes[day] / "identities" / f"{day}.csv").write_text("uid,Full Name,phone\n100012345678901,Old,\n100012345678901,Linh,0966000222\n")
    first, second = str(tmp_path / "in-order"), str(tmp_path / "late")
    for day in boxes:
        jobs.ingest(spark, str(boxes[day]), first, day)
    for day in ("2024-01-01", "2024-01-03", "2024-01-02", "2024-01-02"):
        jobs.ingest(spark, str(boxes[day]), second, day)
    for day in boxes:
        assert contacts_of(spark, first, day) == contacts_of(spark, second, day)
    rejects = spark.read.parquet(f"{second}/rejects").groupBy("run_ts", "reason").count().collect()
    assert {r["count"] for r in rejects if "12" in r["reason"]} == {1} and len({r["run_ts"] for r in rejects}) == 3
    last = {r["phone"]: r for r in ContactStore(spark, f"{first}/contacts").contacts("2024-01-03").collect()}
    assert {"0987654321", "0977000111", "0966000222"} <= last.keys() and last["0966000222"]["name"] == "Linh"
    assert last["0966000222"]["uid"] == "100012345678901" and all(r["latest_file_date"] is not None for r in last.values())
