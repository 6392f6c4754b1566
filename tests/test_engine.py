import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom import cli, errors
from varloom.functions import fields, ids
from varloom.operators.genotypes import LISTED, add_genotypes, genotypes
from varloom.operators.transmission import transmission, transmission_ped
from varloom.operators.variants import annotations, variants
from varloom.plans import files, layout
from varloom.sources.contigs import ContigsLength
from varloom.sources.header import VcfHeader
from varloom.sources.readers import ColRename, read_metadata, read_pedigree, read_variant_csv, read_vcf
from varloom.sources.writers import RowNames, write_parquet, write_pedigree, write_vcf
from varloom.streaming.ingest import ingest_variants, stream_vcf

HEAD = [
    "##fileformat=VCFv4.2", "##contig=<ID=1,length=248956422>", "##contig=<ID=2,length=242193529>", "##contig=<ID=nolength>",
    '##INFO=<ID=AF,Number=1,Type=Float,Description="x">', '##INFO=<ID=AC,Number=A,Type=Integer,Description="x">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">', '##INFO=<ID=TXT,Number=1,Type=String,Description="x">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="x">',
    '##FORMAT=<ID=CNQ,Number=1,Type=Float,Description="x">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA.1\ts2",
]
BODY = [
    "1\t100\trs1\tA\tT\t50\tPASS\tEAF=9;AF=0.5;AC=1,2\tGT:AD:DP:GQ\t0/1:3,4:7:99\t1|1:0,8:8:.",
    '1\t200\t"odd\tAC\tA\t.\t.\tTXT=a b;DB\tGT:AD:DP:GQ\t./.\t./1:1,2',
    "2\t300\t.\tA\t*\t.\t.\tAC=.,3\tGT:AD:DP:GQ\t0/0:9,0:9:10",
    "2\t400\t.\tG\tC\t.\t.\t.\tDP\t9\t9",
    "3\t5\t.\tG\tC\t.\t.\tAF=.\tGT:AD:DP:GQ\t1/1:0,1:1:1\t0/2:1,0:1:1",
]


@pytest.fixture
def vcf_path(tmp_path):
    path = tmp_path / "in.vcf"
    path.write_text("\n".join([*HEAD, *BODY]) + "\n")
    return str(path)


def by_key(frame, key):
    return {tuple(r[k] for k in key): r.asDict() for r in frame.collect()}


CONTIGS = ContigsLength.of([("1", 10_000_000), ("2", 50_000), ("3", 120_000_500), ("22", 99_239_816), ("X", 10_000)])


def test_golden_ids_and_partitions(spark):
    rows = [("2", 19910, "A", "T"), ("1", 3322992, "A" * 10 + "T" * 10 + "C" * 10 + "G" * 10, "C"), ("X", 1292939, "A", "A" * 10 + "T" * 10 + "C" * 10 + "G" * 10), ("3", 399941, "C", "G"), ("22", 11111, "T", "C"), ("2", 16424, "A", "*"), ("Y", 1, "A", "C")]
    frame = spark.createDataFrame(rows, "chr string, pos long, ref string, alt string")
    found = ids.add_id_part(ids.add_variant_id(frame, CONTIGS.frame(spark), CONTIGS.genome_length))
    got = {(r["chr"], r["pos"]): (r["id"], r["id_part"]) for r in found.collect()}
    assert got[("2", 19910)] == (344281486070906886, 9) and got[("1", 3322992)] == (114177135718957217, 3)
    assert got[("3", 399941)] == (359057238721036295, 9) and got[("22", 11111)] == (4468882925680590853, 124)
    assert got[("X", 1292939)][0] < 0 and got[("X", 1292939)][1] == 255 and got[("2", 16424)][0] < 0 and got[("Y", 1)] == (None, None)
    human = spark.createDataFrame([(10146, "AC", "A"), (10440, "CCCCTAA", "C"), (10492, "C", "T"), (100876, "T", "C")], "p long, r string, a string")
    own = [r[0] for r in human.select(ids.variant_id(F.col("p"), F.col("r"), F.col("a"), 3_099_750_718)).collect()]
    assert own == [21788369092616, 22419729285149, 22531398434822, 216629560475653]
    assert ids.pad_length(3_099_750_718) == 16 and ids.position_shift(3_099_750_718) == 31
    ids.register_sql(spark)
    sql = human.selectExpr("variant_id(p, r, a, 3099750718L) AS i", "variant_id_part(variant_id(p, r, a, 3099750718L), 9) AS q")
    assert [r["i"] for r in sql.collect()] == own


def reference_id(pos, ref, alt, genome):
    shift = 63 - genome.bit_length()
    if len(ref).bit_length() + 2 * len(alt) > shift:
        return None
    bases = 0
    for c in alt:
        bases = bases << 2 | (ord(c) >> 1 & 3)
    return pos << shift | len(ref) << 2 * len(alt) | bases


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3_000_000_000), st.text("ACGTN", min_size=0, max_size=9), st.text("ACGTNacgtR", max_size=18)), min_size=1, max_size=40))
def test_ids_equal_bit_packing(spark, rows):
    frame = spark.createDataFrame(rows, "p long, r string, a string")
    id_ = ids.variant_id(F.col("p"), F.col("r"), F.col("a"), 3_099_750_718)
    for r in frame.select("p", "r", "a", id_.alias("i"), ids.from_unsigned(ids.as_unsigned(id_)).alias("j")).collect():
        want = reference_id(r["p"], r["r"], r["a"], 3_099_750_718)
        assert r["i"] == r["j"] and (r["i"] < 0 if want is None else r["i"] == want)


def test_header():
    header = VcfHeader.from_lines([f"{line}\n" for line in HEAD])
    assert header.samples_index == {"NA.1": 0, "s2": 1} and len(header.contigs) == 3
    assert [d[0] for d in header.declared("INFO")] == ["AF", "AC", "TXT"] and [d[0] for d in header.declared("INFO", "AC")] == ["AC"]
    assert set(header.format_parser()) == {"GT", "AD", "DP", "GQ", "CNQ"} and header.format_parser()["CNQ"] is fields.format_text
    assert ContigsLength.from_vcf_header(header).seen == 3 and len(ContigsLength.from_vcf_header(header).rows) == 2
    for lines in (["##x"], ["##x", "1\t2"], []):
        with pytest.raises(errors.NotVcfHeaderError):
            VcfHeader.from_lines(lines)
    with pytest.raises(errors.NotVcfHeaderError):
        VcfHeader(["##x"]).info_parser()
    assert VcfHeader.from_lines(["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]).samples_index is None


def test_error_messages():
    said = [errors.NotAVCFError("test"), errors.NoGenotypeError(), errors.NoGTError("x"), errors.NotVcfHeaderError(), errors.NotAVariantCsvError("p"), errors.NoContigsLengthInformationError()]
    assert [str(e) for e in said] == [
        "File test seems not be a valid vcf file.", "LazyFrame seems not contains genotypes.", "In x gt column is missing.", "Not a vcf header",
        "p seems not be a csv variant.", "Contigs length information is required in vcf header of in compagnion file.",
    ]


def test_vcf_scan(spark, vcf_path, tmp_path):
    vcf = read_vcf(spark, vcf_path)
    rows = by_key(vcf.frame, ("chr", "pos"))
    assert len(rows) == 5 and rows[("1", 200)]["vid"] == '"odd' and rows[("2", 300)]["s2"] is None
    assert rows[("3", 5)]["id"] is None and rows[("2", 300)]["alt"] == "*" * ids.pad_length(vcf.contigs.genome_length) and rows[("2", 300)]["id"] < 0
    assert read_vcf(spark, vcf_path, drop_star=True).frame.count() == 4
    lengths = tmp_path / "len.csv"
    lengths.write_text("contig,length\n3,1000\n1,5000\n2,70\n")
    own = read_vcf(spark, vcf_path, str(lengths))
    assert own.contigs.rows == [("3", 1000, 0), ("1", 5000, 1000), ("2", 70, 6000)] and own.frame.where("id IS NULL").count() == 0
    assert variants(own.frame).columns == ["id", "chr", "pos", "ref", "alt"]
    (tmp_path / "bad.tsv").write_text("a\tb\n")
    with pytest.raises(errors.NotAVCFError):
        read_vcf(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "nocontig.vcf").write_text(HEAD[-1] + "\n")
    with pytest.raises(errors.NoContigsLengthInformationError):
        read_vcf(spark, str(tmp_path / "nocontig.vcf"))


def test_structural_alleles(spark, tmp_path):
    path = tmp_path / "sv.vcf"
    path.write_text('##contig=<ID=1,length=3000000000>\n##INFO=<ID=SVTYPE,Number=1,Type=String,D="">\n##INFO=<ID=SVLEN,Number=.,Type=Integer,D="">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t9\t.\tA\t<DEL:ME:ALU>\t.\t.\tSVTYPE=DEL;SVLEN=-20\n1\t10\t.\tA\t<DUP>\t.\t.\tSVTYPE=DEL;SVLEN=5\n')
    alt = {r["pos"]: r["alt"] for r in read_vcf(spark, str(path)).frame.collect()}
    assert alt == {9: "DEL--20---------", 10: "<DUP>"}


def test_info_and_annotations(spark, vcf_path):
    vcf = read_vcf(spark, vcf_path)
    rows = by_key(annotations(vcf.frame.drop("format", "NA.1", "s2"), vcf.header, rename_id="name"), ("name",))
    assert rows[("rs1",)]["AF"] == 0.5 and rows[("rs1",)]["AC"] == [1, 2] and rows[('"odd',)]["TXT"] == "a b"
    assert [r["AC"] for r in rows.values() if r["AC"]].count([None, 3]) <= 1
    some = annotations(vcf.frame, vcf.header, "AC")
    assert some.columns == ["vid", "format", "NA.1", "s2", "id", "AC"]


def test_genotypes(spark, vcf_path):
    vcf = read_vcf(spark, vcf_path)
    found = genotypes(vcf.frame, vcf.header.format_parser())
    rows = {(r["sample"], r["gt"], tuple(r["ad"] or ()), r["dp"], r["gq"]) for r in found.collect()}
    assert rows == {("NA.1", 1, (3, 4), 7, 99), ("s2", 2, (0, 8), 8, None), ("s2", 1, (1, 2), None, None), ("NA.1", 2, (0, 1), 1, 1)}
    assert genotypes(vcf.frame, vcf.header.format_parser(), "DP").columns == ["id", "sample", "dp"]
    with pytest.raises(errors.NoGenotypeError):
        genotypes(vcf.frame.drop("format"), vcf.header.format_parser())
    with pytest.raises(errors.UnknownFormatError):
        genotypes(vcf.frame, vcf.header.format_parser(), "GT:XX")
    wide = add_genotypes(variants(vcf.frame), found, ["NA.1", "s2", "s2"])
    assert [c for c in wide.columns if c.endswith("_gt")] == ["NA.1_gt", "s2_gt"] and wide.count() == 5


GENOTYPES = [(1, "i", 2, 9), (2, "i", 1, 8), (3, "i", None, 7), (1, "m", 1, 6), (1, "f", 2, 5), (2, "f", 1, 4), (9, "m", 1, 3)]


def test_transmission(spark):
    frame = spark.createDataFrame(GENOTYPES, "id long, sample string, gt int, dp long")
    rows = by_key(transmission(frame, "i", "m", "f"), ("id",))
    assert {k[0]: r["origin"] for k, r in rows.items()} == {1: '#"#', 2: '"!"', 3: "~!!"} and rows[(2,)]["mother_dp"] is None
    assert {r["origin"] for r in transmission(frame, "i", "m").collect()} == {'#"~', '"!~', "~!~"}
    assert {r["origin"] for r in transmission(frame, "i", None, "f").collect()} == {"#~#", '"~"', "~~!"}
    assert transmission(frame, "i").columns == ["id", "index_gt", "index_dp", "mother_gt", "mother_dp", "father_gt", "father_dp", "origin"]
    with pytest.raises(errors.NoGTError):
        transmission(frame.drop("gt"), "i")


def test_pedigree(spark, tmp_path):
    path = tmp_path / "a.ped"
    path.write_text("fam\tm\tNone\tunknown\tF\tFalse\nfam\ti\tf\tm\tM\ttrue\n")
    ped = read_pedigree(spark, str(path))
    assert [r["father_id"] for r in ped.collect()] == [None, "f"] and [r["affected"] for r in ped.collect()] == [False, True]
    frame = spark.createDataFrame(GENOTYPES, "id long, sample string, gt int, dp long")
    assert transmission_ped(frame, ped).count() == 3
    write_pedigree(ped, str(tmp_path / "b.ped"))
    assert read_pedigree(spark, str(tmp_path / "b.ped")).collect() == ped.collect()


def test_csv_and_metadata(spark, tmp_path):
    (tmp_path / "v.csv").write_text("c,p,r,a,z\n1,5,A,T,9\n")
    got = read_variant_csv(spark, str(tmp_path / "v.csv"), ColRename("c", "p", "r", "a", {"z": "extra"}))
    assert got.columns == ["chr", "pos", "ref", "alt", "extra"] and got.first()["pos"] == 5
    with pytest.raises(errors.NotAVariantCsvError):
        read_variant_csv(spark, str(tmp_path / "v.csv"))
    rows = [{"sample": "é1", "kindex": True, "age": 3}, {"sample": "b", "kindex": False, "age": None}]
    (tmp_path / "m.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "m.csv").write_text("sample,kindex,age\né1,true,3\nb,false,\n")
    frames = [read_metadata(spark, str(tmp_path / f"m.{e}"), t) for e, t in (("json", "json"), ("jsonl", "ljson"), ("csv", "csv"))]
    assert all(f.columns == ["sample", "kindex", "age"] for f in frames)
    assert all([r["sample"] for r in f.collect()] == ["é1", "b"] for f in frames)
    with pytest.raises(ValueError):
        read_metadata(spark, "x", "xml")


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "id long, chr string, pos long, ref string, alt string")


def test_merge_and_hive(spark, tmp_path):
    a, b = [(1, "1", 5, "A", "T"), (2, "2", 6, "A", "T")], [(2, "2", 6, "A", "T"), (3, "X", 7, "C", "G")]
    frame_of(spark, a).write.parquet(str(tmp_path / "a"))
    frame_of(spark, b).write.parquet(str(tmp_path / "b"))
    out = str(tmp_path / "merged")
    layout.merge_variants(spark, [str(tmp_path / "a")], out)
    layout.merge_variants(spark, [str(tmp_path / "b")], out, append=True)
    assert {tuple(r) for r in layout.read_variants(spark, out).collect()} == set(a + b) and layout.read_variants(spark, out).count() == 3
    assert "PartitionFilters: [isnotnull(chr" in layout.read_variants(spark, out).where("chr = '2'")._jdf.queryExecution().toString()
    rows = [(k << 55, "s", 1) for k in range(8)] + [(-5, "s", 2)]
    spark.createDataFrame(rows, "id long, sample string, gt int").write.parquet(str(tmp_path / "g"))
    hive = str(tmp_path / "hive")
    layout.hive_genotypes(spark, [str(tmp_path / "g")], hive)
    read = layout.read_genotypes(spark, hive)
    assert {r["id_part"] for r in read.collect()} == {*range(8), 255}
    spark.createDataFrame([(3 << 55, "t", 1)], "id long, sample string, gt int").write.parquet(str(tmp_path / "g2"))
    layout.hive_genotypes(spark, [str(tmp_path / "g2")], hive)
    assert layout.read_genotypes(spark, hive).count() == 9 and layout.read_genotypes(spark, hive).where("sample = 't'").count() == 1
    layout.hive_genotypes(spark, [str(tmp_path / "g2")], hive, append=True)
    assert layout.read_genotypes(spark, hive).count() == 10
    assert layout.lookup_genotypes(layout.read_genotypes(spark, hive), [3 << 55, -5]).count() == 3
    found = layout.join_genotypes(frame_of(spark, [(3 << 55, "1", 1, "A", "C")]), layout.read_genotypes(spark, hive))
    assert found.count() == 2


def test_append_checks_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    write_parquet(spark.range(3), path, append=True)
    write_parquet(spark.range(3), path, append=True)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(ValueError):
        write_parquet(spark.range(3).withColumnRenamed("id", "x"), path, append=True)


def test_vcf_round_trip(spark, vcf_path, tmp_path):
    vcf = read_vcf(spark, vcf_path)
    found = genotypes(vcf.frame, vcf.header.format_parser())
    wide = add_genotypes(variants(vcf.frame).where("id IS NOT NULL"), found, ["NA.1", "s2"])
    keys = {"GT": "gt", "AD": "ad", "DP": "dp", "GQ": "gq"}
    names = RowNames(format="GT:AD:DP:GQ", sample={s: {k: f"{s}_{c}" for k, c in keys.items()} for s in ("NA.1", "s2")})
    out = str(tmp_path / "out.vcf")
    write_vcf(wide, out, names)
    lines = (tmp_path / "out.vcf").read_text().splitlines()
    assert lines[0] == "##fileformat=VCFv4.3" and '##FORMAT=<ID=AD,Number=.,Type=String,Description="Column of the source table">' in lines
    body = [line.split("\t") for line in lines if not line.startswith("#")]
    assert [b[:2] for b in body] == [["1", "100"], ["1", "200"], ["2", "300"], ["2", "400"]]
    assert body[0][9:] == ["0/1:3,4:7:99", "1/1:0,8:8:."] and body[3][9] == "./.:.:.:." and int(body[2][2]) > 2**63
    lengths = tmp_path / "len.csv"
    lengths.write_text("contig,length\n" + "".join(f"{c},{n}\n" for c, n, _ in vcf.contigs.rows))
    again = read_vcf(spark, out, str(lengths))
    short = [{r["id"] for r in f.where("id >= 0").collect()} for f in (again.frame, wide)]
    assert short[0] == short[1] and len(short[0]) == 3
    with_header = str(tmp_path / "own.vcf")
    write_vcf(wide.select("id", "chr", "pos", "ref", "alt"), with_header, header=vcf.header)
    assert (tmp_path / "own.vcf").read_text().splitlines()[: len(HEAD) - 1] == HEAD[:-1]


def test_command_line(spark, vcf_path, tmp_path):
    at = {n: str(tmp_path / n) for n in ("v", "g", "a", "h.txt", "m", "hive", "t", "o.vcf", "meta")}
    assert cli.main(["vcf2parquet", "-i", vcf_path, "variants", "-o", at["v"], "genotypes", "-o", at["g"], "annotations", "-o", at["a"], "-i", "AF", "AC", "headers", "-o", at["h.txt"]], spark) == 0
    assert (tmp_path / "h.txt").read_text().splitlines() == HEAD and spark.read.parquet(at["a"]).columns[-2:] == ["AF", "AC"]
    assert cli.main(["struct", "-i", at["v"], "variants", "-o", at["m"]], spark) == 0
    assert cli.main(["struct", "-i", at["g"], "genotypes", "-p", at["hive"], "-n", "256"], spark) == 0
    assert cli.main(["transmission", "-g", at["g"], "-i", "NA.1", "-m", "s2", "-o", at["t"]], spark) == 0
    assert cli.main(["transmission", "-g", at["g"], "-o", at["t"]], spark) == 31
    assert cli.main(["parquet2vcf", "-v", at["v"], "-g", at["g"], "-s", "1", "-o", at["o.vcf"], "-H", at["h.txt"]], spark) == 0
    text = (tmp_path / "o.vcf").read_text().splitlines()
    assert text[len(HEAD) - 1].startswith("#CHROM") and len(text) == len(HEAD) + 2
    (tmp_path / "bad.tsv").write_text("a\n")
    assert cli.main(["vcf2parquet", "-i", str(tmp_path / "bad.tsv"), "variants", "-o", at["v"]], spark) == 12
    (tmp_path / "no.vcf").write_text(HEAD[-1] + "\n")
    assert cli.main(["vcf2parquet", "-i", str(tmp_path / "no.vcf"), "variants", "-o", at["v"]], spark) == 13
    (tmp_path / "m.csv").write_text("sample,x\na,1\n")
    assert cli.main(["metadata", "-i", str(tmp_path / "m.csv"), "-o", at["meta"], "-t", "csv"], spark) == 0
    assert spark.read.parquet(at["meta"]).count() == 1 and cli.main(["--debug-info"], spark) == 0


def test_streaming_ingest(spark, vcf_path, tmp_path):
    folder, out = tmp_path / "inbox", str(tmp_path / "out")
    folder.mkdir()
    (folder / "1.vcf").write_text("\n".join([*HEAD, *BODY[:2]]) + "\n")
    contigs = ContigsLength.from_vcf_header(VcfHeader(HEAD))

    def run():
        stream = stream_vcf(spark, str(folder), contigs, ["NA.1", "s2"])
        ingest_variants(stream, out, str(tmp_path / "state")).awaitTermination()
        return layout.read_variants(spark, out).count()

    assert run() == 2
    (folder / "2.vcf").write_text("\n".join([*HEAD, *BODY[1:4]]) + "\n")
    assert run() == 4 and run() == 4


def test_transmission_repeats_and_null_ids(spark):
    """Every combination of repeated rows, as joins on id give them."""
    rows = [(1, "i", 1, 1), (1, "i", 2, 2), (1, "m", 1, 3), (1, "m", 2, 4), (1, "f", 1, 5), (None, "i", 1, 6), (None, "i", 1, 7), (None, "m", 2, 8), (2, "m", 1, 9)]
    frame = spark.createDataFrame(rows, "id long, sample string, gt int, dp long")
    i, m, f = ([r for r in rows if r[1] == s] for s in "imf")
    want = []
    for a in i:
        mothers = [b for b in m if b[0] == a[0] and a[0] is not None] or [(None, None, 0, None)]
        fathers = [b for b in f if b[0] == a[0] and a[0] is not None] or [(None, None, 0, None)]
        want += [(a[0], a[2], a[3], b[2], b[3], c[2], c[3]) for b in mothers for c in fathers]
    got = [tuple(r)[:-1] for r in transmission(frame, "i", "m", "f").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_wide_cohort_equals_columns(spark, vcf_path):
    names = ["NA.1", "s2"]
    narrow, wide = read_vcf(spark, vcf_path), read_vcf(spark, vcf_path, wide=1)
    assert "_samples" in wide.frame.columns and "s2" not in wide.frame.columns
    a, b = (genotypes(v.frame, v.header.format_parser(), samples=names) for v in (narrow, wide))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() == 4


def test_wide_cohort_to_vcf_and_back(spark, tmp_path):
    """More samples than get columns: one list from genotypes to a sharded VCF and back, repeated genotypes whole."""
    samples = [f"p{k}" for k in range(230)]
    v = spark.createDataFrame([(1, "chr10", 5, "A", "T"), (2, "chr2", 7, "A", "C"), (3, "chr2", 9, "G", "C")], "id long, chr string, pos long, ref string, alt string")
    g = [(1, f"p{k}", 1 + k % 2, 10 + k) for k in range(0, 230, 3)] + [(2, "p7", 1, 50), (2, "p7", 2, None), (2, "p229", 1, 4), (9, "p1", 1, 1)]
    long = spark.createDataFrame(g, "id long, sample string, gt int, dp long")
    frame = add_genotypes(v, long, samples)
    assert LISTED in frame.columns and len(frame.columns) == 6
    names = RowNames(format="GT:DP", listed=samples, keys={"GT": "gt", "DP": "dp"})
    at = str(tmp_path / "wide")
    header = VcfHeader(["##fileformat=VCFv4.3", "##contig=<ID=chr2,length=50>", "##contig=<ID=chr10,length=50>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="">'])
    write_vcf(frame, at, names, header, sharded=True)
    lines = [x for x in spark.read.text(at).collect() if not x[0].startswith("#")]
    assert len(lines) == 3 and sorted(x[0].split("\t")[0] for x in lines) == ["chr10", "chr2", "chr2"]
    back = {r["pos"]: r[LISTED] for r in read_vcf(spark, at).frame.collect()}
    told = {1: "0/1", 2: "1/1"}
    assert back[5] == [f"{told[1 + k % 2]}:{10 + k}" if k % 3 == 0 else "./.:." for k in range(230)]
    assert back[7] == ["1/1:." if k == 7 else "0/1:4" if k == 229 else "./.:." for k in range(230)] and set(back[9]) == {"./.:."}


def test_one_file_is_in_genome_order(spark, tmp_path):
    rows = [(k, c, p, "A", "T") for k, (c, p) in enumerate([("chr10", 1), ("chr2", 9), ("chrX", 2), ("chr2", 3), ("chr1", 5)])]
    frame = spark.createDataFrame(rows, "id long, chr string, pos long, ref string, alt string")
    write_vcf(frame, str(tmp_path / "a.vcf"))
    told = [line.split("\t")[:2] for line in (tmp_path / "a.vcf").read_text().splitlines() if not line.startswith("#")]
    assert told == [["chr1", "5"], ["chr2", "3"], ["chr2", "9"], ["chr10", "1"], ["chrX", "2"]]
    header = VcfHeader(["##contig=<ID=chrX,length=9>", "##contig=<ID=chr10,length=9>"])
    write_vcf(frame, str(tmp_path / "b.vcf"), header=header)
    told = [line.split("\t")[0] for line in (tmp_path / "b.vcf").read_text().splitlines() if not line.startswith("#")]
    assert told == ["chrX", "chr10", "chr1", "chr2", "chr2"]


def test_order_in_a_file_of_over_one_gigabyte(spark, monkeypatch):
    """Half of the lines stand behind 1.1 GB of comments, most of which is a hole in the file."""
    sf, run = "/root/testdata/sf0.001", files._cli
    want = sorted(map(tuple, files.vcf_order(spark, sf).collect()))

    def stretched(spark, *words):
        run(spark, *words)
        out = Path(words[-1].removeprefix("file:"))
        lines = out.read_bytes().splitlines(keepends=True)
        half = len(lines) // 2
        with out.open("wb") as file:
            file.writelines(lines[:half])
            for k in range(1, 1100):
                file.write(b"#")
                file.seek(k << 20)
                file.write(b"\n")
            file.writelines(lines[half:])
        out.with_name(f".{out.name}.crc").unlink(missing_ok=True)

    monkeypatch.setattr(files, "_cli", stretched)
    assert sorted(map(tuple, files.vcf_order(spark, sf).collect())) == want


def test_appends_match_null_keys_and_replace_tables(spark, tmp_path):
    kind = "id long, chr string, pos long, ref string, alt string"
    for name, rows in (("a", [(1, "chr1", 1, "A", "T"), (None, None, 2, "A", None)]), ("b", [(None, None, 2, "A", None), (3, "chr2", 4, "G", "C")])):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
    old, at = spark.conf.get("spark.sql.sources.partitionOverwriteMode"), str(tmp_path / "merged")
    try:
        for mode in ("static", "dynamic"):
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
            layout.merge_variants(spark, [str(tmp_path / "a")], at)
            layout.merge_variants(spark, [str(tmp_path / "b")], at, append=True)
            layout.merge_variants(spark, [str(tmp_path / "b")], at, append=True)
            assert layout.read_variants(spark, at).count() == 3
            layout.merge_variants(spark, [str(tmp_path / "b")], at)
            assert {r["chr"] for r in layout.read_variants(spark, at).collect()} == {None, "chr2"}
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def test_debug_info(capsys):
    assert cli.main(["--debug-info"]) == 0
    told = capsys.readouterr().out
    assert "python: " in told and "pyspark: " in told and "pyarrow: " in told
