"""Trees of files become candidates and projects; contents are never read."""

from tessellate.plans.listings import archive_projects, candidates
from tessellate.sources.listing import files, walk

BID = ("00 Contract/SVOA/SVOA009 work/SGP251009015(x).pdf", "00 Contract/SVOA/SVOA010.PDF", "00 Contract/NT/deep/er/NT 123 a b.pdf", "00 Contract/NT/no code.pdf", "00 Contract/NT/NTX002 PO.pdf", "00 Contract/NT/note NTX003.txt", "00 Contract/NTX004.pdf", "01 Proof/SVOA/SVOA009 100%.pdf", "01 Proof/SVOA/SVOA010 attachment.pdf", "other/SVOA/SVOA011.pdf")
ARCHIVE = ("_Project 2015-2020/MEA/Job a/_TOR/x.txt", "_Project 2015-2020/MEA/Job a/mail/y.txt", "_Project 2015-2020/MEA/Job b/mail/y.txt", "_Project 2015-2020/NT/2018/Job c/z.txt", "_Project 2015-2020/NT/2018/loose.txt", "_Project old/NT/Job d/Proposal 1/q/z.txt", "elsewhere/NT/Job e/_TOR/z.txt", "_Project old/top.txt")


def tree(root, paths):
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(p)


def test_candidates_of_a_tree(spark, tmp_path):
    tree(tmp_path, BID)
    listed = files(spark, str(tmp_path))
    assert {(r.path, r.size) for r in listed.collect()} == {(p, len(p)) for p in BID}
    assert {r.path for r in files(spark, f"file://{tmp_path}/", "*.txt").collect()} == {p for p in BID if p.endswith(".txt")}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    projects, unmatched, excluded = candidates(listed, {"00 Contract": "contract", "01 Proof": "certificate"})
    got = {r.code: (r.client, r.contract, r.certificate) for r in projects.collect()}
    assert got == {"SVOA009": ("SVOA", [BID[0]], [BID[7]]), "SVOA010": ("SVOA", [BID[1]], []), "NT123": ("NT", [BID[2]], [])}
    assert [r.path for r in unmatched.collect()] == [BID[3]]
    assert [(r.code, r.excluded) for r in excluded.collect()] == [("NTX002", [BID[4]])]


def test_archives_of_a_tree(spark, tmp_path):
    tree(tmp_path, ARCHIVE)
    (tmp_path / "_Project old/NT/Job f/_tor old").mkdir(parents=True)
    (tmp_path / "_Project old/NT/Job g").mkdir()
    (tmp_path / "_Project old/link").symlink_to(tmp_path)
    entries = walk(spark, str(tmp_path))
    assert {(r.path, r.size) for r in entries.where("path NOT LIKE '%/' AND path NOT LIKE '%/link'").collect()} == {(p, len(p)) for p in ARCHIVE}
    assert entries.where("unreadable OR modified IS NULL").count() == 0 and entries.where("path LIKE '%/' AND size IS NOT NULL").count() == 0
    gone = walk(spark, f"{tmp_path}/none").collect()
    assert [(r.path, r.unreadable) for r in gone] == [("", True)]
    got = {(r.client, r.project, r.layout, r.year_hint) for r in archive_projects(entries).collect()}
    assert got == {("MEA", "Job a", "project", 2015), ("MEA", "Job b", "skipped", None), ("NT", "Job c", "year/project", 2018), ("NT", "Job d", "project", None), ("NT", "Job f", "project", None), ("NT", "Job g", "skipped", None)}
