"""Command line: python -m flowspark.plans.cli COMMAND ...

An input may be a file, a folder or a pattern, and commands that read reads take several. An output is a folder whose
parts, joined in order, are the file; --one-file writes the file itself. Outputs take their names once they are whole."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chimera, clean, cluster, mapping, ordinals, otu, pairs, split, unique
from ..operators.stage import staged
from ..sources import sff, sinks, text
from . import pipelines


def _finish(spark, a, *paths: str) -> None:
    """With --one-file, each folder's parts become the file <path>.txt beside it."""
    if a.one_file:
        for path in paths:
            sinks.join_parts(spark, path, f"{path}.txt")


def _reads(spark, paths: list[str]) -> DataFrame:
    """ord, read_id, clip, flows (and what SFF has more) of raw, SFF and text dumps, by their names' ends."""
    kinds = {"sff": [p for p in paths if p.endswith(".sff")], "raw": [p for p in paths if p.endswith(".raw")]}
    rest = [p for p in paths if p not in kinds["sff"] + kinds["raw"]]
    parts = []
    if kinds["sff"]:
        rows = sff.scan_sff(spark, kinds["sff"])
        steps = F.aggregate(F.slice("flow_index", 1, F.col("clip_right")), F.lit(0), lambda s, x: s + x)
        parts.append(rows.withColumn("clip", steps))
    parts += [text.scan_raw(spark, p) for p in kinds["raw"]] + [text.scan_sffinfo(spark, p) for p in rest]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _clean(spark, a):
    reads = _reads(spark, a.inputs)
    if len(a.inputs) > 1:
        reads = ordinals.with_ordinal(reads.drop("ord"))
    done = clean.clean_reads(reads, a.primer, a.min_flows, a.max_flows, a.max_empty, high=a.high, greedy=a.greedy, anchored=a.anchored)
    passed = done.where("passed")
    sinks.sink_fasta(passed.withColumnRenamed("read_id", "seq_id"), f"{a.output}.fa")
    sinks.sink_dat(passed, f"{a.output}.dat")
    _finish(spark, a, f"{a.output}.fa", f"{a.output}.dat")
    print(clean.pass_fail(done).first().asDict())


def _split(spark, a):
    barcodes = text.scan_barcodes(spark, a.barcodes)
    table = barcodes.join(split.check_barcodes(barcodes).select("name", "primer_re"), "name")
    done = split.split_by_barcode(_reads(spark, a.inputs), table, a.unmatched_name)
    if a.format == "raw":
        sinks.sink_split_raw(done, a.output)
    elif a.format == "sff":
        flow_chars = (done.select(F.max(F.size("flows"))).first()[0] or 0) // 4 * "TACG"
        sff.sink_sff(done, a.output if "://" in a.output else f"file://{a.output}", "sample", flow_chars).collect()  # a row a sample
    else:
        sinks.sink_split(done, a.output)
    counts = staged(split.split_counts(done))
    sinks.write_whole(counts.orderBy(F.desc("n"), "sample").select(F.concat_ws("\t", "sample", F.col("n").cast("string"))), f"{a.output}.counts")
    _finish(spark, a, f"{a.output}.counts")
    if a.write_control:
        control = sinks.control_rows(counts, barcodes.select("name", "barcode", "primer"), a.format)
        control.select("sample", F.col("control").alias("value")).write.mode("overwrite").partitionBy("sample").text(f"{a.output}.control")
    split.split_counts(done, 30).show(30, False)


def _split_by_key(spark, a):
    done, rejected = split.split_by_key(_reads(spark, a.inputs), text.scan_keyfile(spark, a.keys), a.primer)
    sinks.sink_split(done, a.output)
    rejected.write.mode("overwrite").parquet(f"{a.output}.rejected")
    split.split_counts(done, 30).show(30, False)


def _flow_denoise(spark, a):
    reads = ordinals.with_ordinal(_reads(spark, a.inputs).drop("ord")).withColumn("block", F.lit(a.stub))
    lookup = text.scan_lookup(spark, a.lookup)[0] if a.lookup else None
    out = pipelines.flow_denoise_plan(reads, "block", a.primer, a.min_flows, a.max_flows, a.max_empty, a.sigma, a.cutoff, lookup).drop("block")
    sinks.sink_clusters(staged(out), a.stub, a.output)


def _sequence_denoise(spark, a):
    seqs = text.scan_fasta(spark, a.input, "ACGT").withColumn("block", F.lit(a.stub))
    costs = text.scan_tran(spark, a.costs) if a.costs else None
    out = staged(pipelines.sequence_denoise_plan(seqs, "block", a.sigma, a.cutoff, costs, a.length).drop("block"))
    sinks.sink_clusters(out, a.stub, a.output)
    if a.mapping:
        found = out.select("cluster", F.get("member_ords", F.lit(0)).alias("medoid"), "member_ords")
        full = mapping.output_mapping(found, text.scan_mapping(spark, a.mapping).withColumnRenamed("name", "cluster_id"))
        sinks.sink_mapping(full.select(F.col("cluster").alias("ord"), F.col("centre").alias("rep"), "members"), f"{a.output}/{a.stub}_cd.mapping")


def _truncate(spark, a):
    from ..functions.sequences import truncate_tag

    seqs = text.scan_fasta(spark, a.input)
    sinks.sink_fasta(seqs.withColumn("seq", truncate_tag("seq", a.tag, a.length)), a.output)
    _finish(spark, a, a.output)


def _wfasta(spark, a):
    seqs = text.scan_fasta(spark, a.input)
    if a.repeat:
        out = mapping.wfasta_repeat(seqs, "seq_id", "seq")
        sinks.write_whole(out.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq")), a.output)
    elif a.min_frequency:
        sinks.sink_fasta(mapping.min_frequency(seqs, "seq_id", a.min_frequency), a.output)
    else:
        sinks.sink_wfasta_table(mapping.wfasta_table(seqs, "seq_id", "seq"), a.output)


def _redup(spark, a):
    """Two folders of a FASTA file a cluster: of reads by flows, and of these by sequences."""
    files = lambda folder: ordinals.with_ordinal(text.scan_noise_dir(spark, f"{folder}/i_[0-9]*.fa"))
    merged = mapping.merge_mapping(files(a.sequence_folder), files(a.flow_folder))
    out = mapping.redup(text.scan_fasta(spark, a.input).select(F.col("seq_id").alias("cluster_id"), "seq"), merged.drop("ord"))
    sinks.write_whole(out.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq")), a.output)
    _finish(spark, a, a.output)


def _sff2raw(spark, a):
    reads = sff.sff_to_raw(sff.scan_sff(spark, a.inputs))
    sinks.sink_raw(ordinals.with_ordinal(reads.orderBy("file", "ord").drop("file", "ord")), a.output, a.barcode, a.inputs[0].rsplit("/", 1)[-1])
    _finish(spark, a, a.output)


def _unique(spark, a):
    seqs = text.scan_fasta(spark, a.input)
    done = staged(unique.fasta_unique(seqs))
    maps = unique.unique_map(done)
    reps = maps.join(seqs.select(F.col("ord").alias("rep_ord"), "seq"), "rep_ord")
    sinks.sink_fasta(reps.select(F.col("rep_ord").alias("ord"), F.concat_ws("_", "rep_id", F.col("n").cast("string")).alias("seq_id"), "seq"), f"{a.output}.fa")
    sinks.sink_unique_map(maps, f"{a.output}.map")
    _finish(spark, a, f"{a.output}.fa", f"{a.output}.map")


def _distances(spark, a):
    if a.kind == "flow":
        lookup = text.scan_lookup(spark, a.lookup)[0] if a.lookup else None
        rows = text.scan_dat(spark, a.input)
        found = pairs.flow_distances(rows, lookup)
    else:
        rows = text.scan_fasta(spark, a.input)
        costs = text.scan_tran(spark, a.costs) if a.costs else None
        found = pairs.identity_distances(rows) if a.kind == "identity" else pairs.sequence_distances(rows, costs)
    sinks.sink_dist(found, rows.count(), a.output)
    _finish(spark, a, a.output)


def _linkage(spark, a):
    rows = text.scan_dist(spark, a.input, ids=a.ids, full=a.full).withColumn("block", F.lit("all"))
    weights = text.scan_fasta(spark, a.weights).select(F.lit("all").alias("block"), "ord", "weight") if a.weights else None
    merges = staged(cluster.linkage(rows, "block", "average" if a.average or a.weights else "complete", a.rescale, weights))
    levels = staged(cluster.cut_levels(merges, "block", a.resolution))
    sinks.sink_levels(levels, f"{a.output}.list")
    sinks.sink_sizes(levels, f"{a.output}.otu")
    sinks.sink_tree(cluster.newick(merges, "block"), f"{a.output}.tree")
    _finish(spark, a, f"{a.output}.list", f"{a.output}.otu", f"{a.output}.tree")


def _split_tree(spark, a):
    """Even splits of a large sample: the reads of each, by a linkage of its distances."""
    rows = text.scan_dist(spark, a.input).withColumn("block", F.lit("all"))
    parts = staged(cluster.split_even(cluster.linkage(rows, "block", "average"), "block", a.most, a.least))
    maps = text.scan_unique_map(spark, a.map)
    leaves = ordinals.with_ordinal(maps.orderBy("u"), "member").select("member", F.explode("members").alias("ord"))
    reads = parts.join(leaves, "member").join(text.scan_dat(spark, a.dat), "ord")
    sinks.write_whole(reads.select("split", "ord", "read_id", "len", "flows").orderBy("split", "ord"), a.output, "parquet")
    cluster.split_totals(parts, leaves.groupBy(F.lit("all").alias("block"), "member").agg(F.count(F.lit(1)).alias("n")), "block").show(100, False)


def _chimeras(spark, a):
    seqs = text.scan_fasta(spark, a.input).withColumn("block", F.lit("all")).withColumn("freq", F.col("weight"))
    good, bad = pipelines.chimera_plan(seqs, "block", a.primer, a.alpha, a.beta, a.below)
    sinks.sink_fasta(staged(good), f"{a.output}_good.fa")
    sinks.sink_fasta(staged(bad), f"{a.output}_bad.fa")
    _finish(spark, a, f"{a.output}_good.fa", f"{a.output}_bad.fa")


def _members(spark, a) -> DataFrame:
    """otu, pos, seq_id, sample, freq, weight, seq of a level of a list over weighted sequences: the sample is what stands
    before _<number>_<frequency>."""
    level = text.scan_levels(spark, a.list).where(F.round(F.col("cutoff"), 6) == round(a.cutoff, 6))
    rows = level.select(F.col("cluster").alias("otu"), F.posexplode("members").alias("pos", "_m")).withColumn("ord", F.col("_m").cast("bigint"))
    seqs = text.scan_fasta(spark, a.input).select("ord", "seq_id", "weight", "seq")
    name = r"^(.*)_\d+_(\d+)$"
    return rows.join(seqs, "ord").withColumns({"sample": F.regexp_extract("seq_id", name, 1), "freq": F.col("weight").cast("bigint")})


def _otu_table(spark, a):
    members = staged(_members(spark, a))
    samples = otu.sample_order([r[0] for r in members.select("sample").distinct().collect()])  # a column each
    lineages = text.scan_taxonomy(spark, a.taxonomy).withColumn("otu", F.col("otu").cast("int")) if a.taxonomy else None
    otu.otu_table(members, samples, lineages).orderBy("otu").write.mode("overwrite").csv(a.output, sep="\t", header=True)


def _typical(spark, a):
    found = otu.otu_typical(_members(spark, a))
    sinks.sink_fasta(found.select(F.col("otu").alias("ord"), F.concat_ws("_", F.lit("otu"), F.col("otu").cast("string"), F.col("weight").cast("bigint").cast("string")).alias("seq_id"), "seq"), a.output)
    _finish(spark, a, a.output)


def _sample(spark, a):
    rows = mapping.sample_n(text.scan_dat(spark, a.input), a.n, a.seed)
    sinks.sink_dat(rows, a.output)
    _finish(spark, a, a.output)


def _join(spark, a):
    joined = mapping.dat_join(*(text.scan_dat(spark, p) for p in a.inputs))
    sinks.sink_dat(joined.withColumn("read_id", F.col("ord").cast("string")), a.output)
    _finish(spark, a, a.output)


COMMANDS = {
    "clean": (_clean, ["primer", "output", "inputs"]), "split": (_split, ["barcodes", "output", "inputs"]), "split_by_key": (_split_by_key, ["keys", "primer", "output", "inputs"]),
    "flow_denoise": (_flow_denoise, ["output", "inputs"]), "sequence_denoise": (_sequence_denoise, ["input", "output"]), "truncate": (_truncate, ["tag", "length", "input", "output"]), "wfasta": (_wfasta, ["input", "output"]),
    "redup": (_redup, ["input", "flow_folder", "sequence_folder", "output"]), "sff2raw": (_sff2raw, ["output", "inputs"]), "unique": (_unique, ["input", "output"]), "distances": (_distances, ["kind", "input", "output"]),
    "linkage": (_linkage, ["input", "output"]), "split_tree": (_split_tree, ["input", "map", "dat", "output"]), "chimeras": (_chimeras, ["input", "output"]), "otu_table": (_otu_table, ["list", "input", "output"]),
    "typical": (_typical, ["list", "input", "output"]), "sample": (_sample, ["n", "input", "output"]), "join": (_join, ["output", "inputs"]),
}
#: Options by command: name, and what argparse is told.
_FLOWS = {"--max-flows": {"type": int, "default": 720}, "--max-empty": {"type": int, "default": 0}}
_FLAG = {"action": "store_true"}
OPTIONS = {
    "clean": {"--min-flows": {"type": int, "default": 360}, **_FLOWS, "--high": {"type": int, "default": 949}, "--greedy": _FLAG, "--anchored": _FLAG},
    "split": {"--unmatched-name": {"default": "unmatched"}, "--write-control": _FLAG, "--format": {"choices": ["parquet", "raw", "sff"], "default": "parquet"}},
    "flow_denoise": {"--min-flows": {"type": int, "default": 320}, **_FLOWS, "--primer": {"default": "."}, "--stub": {"default": "flow_denoise"}, "--sigma": {"type": float, "default": 60.0}, "--cutoff": {"type": float, "default": 0.01}, "--lookup": {}},
    "sequence_denoise": {"--stub": {"default": "sequence_denoise"}, "--sigma": {"type": float, "default": 30.0}, "--cutoff": {"type": float, "default": 0.08}, "--costs": {}, "--length": {"type": int}, "--mapping": {}},
    "wfasta": {"--repeat": _FLAG, "--min-frequency": {"type": int}}, "sff2raw": {"--barcode": {"default": ""}}, "distances": {"--lookup": {}, "--costs": {}},
    "linkage": {"--average": _FLAG, "--weights": {}, "--rescale": _FLAG, "--resolution": {"type": float, "default": 0.01}, "--ids": _FLAG, "--full": _FLAG},
    "split_tree": {"--most": {"type": int, "default": 5000}, "--least": {"type": int, "default": 1000}},
    "chimeras": {"--primer": {}, "--alpha": {"type": float, "default": -7.5}, "--beta": {"type": float, "default": 0.5}, "--below": {"type": float, "default": 0.5}},
    "otu_table": {"--cutoff": {"type": float, "default": 0.03}, "--taxonomy": {}}, "typical": {"--cutoff": {"type": float, "default": 0.03}}, "sample": {"--seed": {"type": int, "default": 1}},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="flowspark")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, places) in COMMANDS.items():
        p = commands.add_parser(name)
        for place in places:
            more = {"nargs": "+"} if place == "inputs" else {"type": int} if place in ("length", "n") else {"choices": ["flow", "identity", "sequence"]} if place == "kind" else {}
            p.add_argument(place, **more)
        for option, told in OPTIONS.get(name, {}).items():
            p.add_argument(option, **told)
        p.add_argument("--one-file", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command][0](SparkSession.builder.appName("flowspark").getOrCreate(), args)


if __name__ == "__main__":
    main()
