"""Commands from files to files."""

import pytest

from flowspark.plans import cli
from flowspark.sources import sff, text

from .test_operators import encode


def record(name, seq):
    flows = encode(seq)
    return {"read_id": name, "clip_left": 4, "clip_right": len(seq), "flows": flows, "flow_index": steps(seq), "bases": seq, "quals": [30] * len(seq)}


def steps(seq):
    """Flows from each base to the next."""
    out, at, last = [], -1, 0
    for base in seq:
        if at < 0 or base != seq[len(out) - 1]:
            at += 1
            while "TACG"[at % 4] != base:
                at += 1
        out.append(at + 1 - last)
        last = at + 1
    return out


def pad(reads):
    n = max(len(r["flows"]) for r in reads)
    return [r | {"flows": r["flows"] + [0] * (n - len(r["flows"]))} for r in reads], "TACG" * (n // 4)


def run(spark, *args):
    cli.main([str(a) for a in args])


def parts(path):
    return "".join(p.read_text() for p in sorted(path.rglob("part-*")))


def test_from_binary_files_to_clusters(spark, tmp_path, capsys):
    a, chars = pad([record(f"a{k}", "TCAG" + "ACGT" + "CATTACGACCA") for k in range(3)] + [record("a3", "TCAG" + "CTCT" + "CAGGTACGTTA")])
    b, chars_b = pad([record("b0", "TCAG" + "CTCT" + "CAGGTACGTTA"), record("b1", "TCAG" + "GGGG" + "CATTACG")])
    (tmp_path / "a.sff").write_bytes(sff.build_sff(a, chars))
    (tmp_path / "b.sff").write_bytes(sff.build_sff(b, chars_b))
    (tmp_path / "codes.csv").write_text("one,ACGT,CAT\ntwo,CTCT,CAR\n")
    run(spark, "split", tmp_path / "codes.csv", tmp_path / "split", tmp_path / "a.sff", tmp_path / "b.sff", "--format", "raw", "--write-control", "--unmatched-name", "rest", "--one-file")
    assert (tmp_path / "split.counts.txt").read_text() == "one\t3\ntwo\t2\nrest\t1\n"
    assert "\"sequence_count\":3" in parts(tmp_path / "split.control" / "sample=one")
    one = text.scan_raw(spark, str(tmp_path / "split" / "sample=two")).orderBy("ord").collect()
    assert [r["read_id"] for r in one] == ["a3", "b0"]
    run(spark, "sff2raw", tmp_path / "raw", tmp_path / "a.sff", tmp_path / "b.sff")
    assert [r["read_id"] for r in text.scan_raw(spark, str(tmp_path / "raw")).orderBy("ord").collect()] == ["a0", "a1", "a2", "a3", "b0", "b1"]
    run(spark, "clean", "ACGTCAY", tmp_path / "clean", tmp_path / "a.sff", tmp_path / "b.sff", "--min-flows", 4, "--max-flows", 40)
    assert "'passed': 3" in capsys.readouterr().out
    assert {r["seq"] for r in text.scan_fasta(spark, str(tmp_path / "clean.fa")).collect()} == {"ACGTCATTACGACCA"}
    run(spark, "flow_denoise", tmp_path / "noise", tmp_path / "a.sff", "--min-flows", 4, "--max-flows", 40, "--stub", "s", "--cutoff", 0.5)
    assert sorted(r["weight"] for r in text.scan_fasta(spark, str(tmp_path / "noise" / "s_cd.fa")).collect()) == [1.0, 3.0]


def test_from_sequences_to_tables(spark, tmp_path, capsys):
    base, other = "ACGTTGCAACGTTAGCCATG", "TTTTGGGGCCCCAAAATTTT"
    (tmp_path / "x.fa").write_text("".join(f">s{1 + k % 2}_{k}_{w}\n{s}\n" for k, (s, w) in enumerate([(base, 9), (base[:12], 2), (other, 4), (base, 3)])))
    run(spark, "unique", tmp_path / "x.fa", tmp_path / "u", "--one-file")
    assert (tmp_path / "u.fa.txt").read_text() == f">s1_2_4_1\n{other}\n>s2_3_3_3\n{base}\n"
    assert [(r["rep_ord"], r["members"]) for r in text.scan_unique_map(spark, str(tmp_path / "u.map")).orderBy("u").collect()] == [(2, [2]), (3, [0, 1, 3])]
    run(spark, "distances", "identity", tmp_path / "x.fa", tmp_path / "d")
    run(spark, "linkage", tmp_path / "d", tmp_path / "l", "--average", "--one-file")
    levels = text.scan_levels(spark, str(tmp_path / "l.list")).where("level = 3").orderBy("cluster").collect()
    assert [sorted(map(int, r["members"])) for r in levels] == [[0, 1, 3], [2]]
    assert (tmp_path / "l.tree.txt").read_text().count("(") == 3
    run(spark, "otu_table", tmp_path / "l.list", tmp_path / "x.fa", tmp_path / "t")
    assert parts(tmp_path / "t").splitlines() == ["otu\ts1\ts2", "0\t9\t5", "1\t4\t0"]
    run(spark, "typical", tmp_path / "l.list", tmp_path / "x.fa", tmp_path / "typical")
    assert {r["seq"] for r in text.scan_fasta(spark, str(tmp_path / "typical")).collect()} == {base, other}
    run(spark, "chimeras", tmp_path / "x.fa", tmp_path / "c")
    assert text.scan_fasta(spark, str(tmp_path / "c_good.fa")).count() + sum(1 for _ in parts(tmp_path / "c_bad.fa").split(">")[1:]) == 4
    run(spark, "sequence_denoise", tmp_path / "x.fa", tmp_path / "n", "--stub", "n")
    assert sum(r["weight"] for r in text.scan_fasta(spark, str(tmp_path / "n" / "n_cd.fa")).collect()) == 18


def test_repeats_from_two_folders(spark, tmp_path):
    for name, files in {"flows": {"i_0.fa": ">f_0_2\nAC\n>r1\nAC\n>r2\nAC\n", "i_1.fa": ">f_1_1\nGT\n>r3\nGT\n", "other.fa": ">no\nA\n"}, "seqs": {"i_0.fa": ">>s_0_3\nAC\n>f_0_2\nAC\n>f_1_1\nGT\n"}}.items():
        (tmp_path / name).mkdir()
        for f, body in files.items():
            (tmp_path / name / f).write_text(body)
    (tmp_path / "d.fa").write_text(">s_0_3\nACAC\n")
    run(spark, "redup", tmp_path / "d.fa", tmp_path / "flows", tmp_path / "seqs", tmp_path / "out")
    assert sorted((r["seq_id"], r["seq"]) for r in text.scan_fasta(spark, str(tmp_path / "out")).collect()) == [("r1", "ACAC"), ("r2", "ACAC"), ("r3", "ACAC")]


def test_dat_files_are_joined_and_sampled(spark, tmp_path):
    for k, n in enumerate((3, 4)):
        (tmp_path / f"{k}.dat").write_text(f"{n} 2\n" + "".join(f"{i} 2 1.00 0.{k}{i}\n" for i in range(n)))
    run(spark, "join", tmp_path / "j", tmp_path / "0.dat", tmp_path / "1.dat")
    got = text.scan_dat(spark, str(tmp_path / "j")).orderBy("ord").collect()
    assert [r["read_id"] for r in got] == [str(k) for k in range(7)] and got[4]["flows"] == [100, 11]
    run(spark, "sample", 4, tmp_path / "j", tmp_path / "s")
    assert text.scan_dat(spark, str(tmp_path / "s")).count() == 4


@pytest.mark.parametrize("command", sorted(cli.COMMANDS))
def test_commands_explain_themselves(command, capsys):
    with pytest.raises(SystemExit):
        cli.parser().parse_args([command, "--help"])
    assert "--one-file" in capsys.readouterr().out
