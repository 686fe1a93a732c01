"""FASTA by byte ranges: the index and the rows against the whole files, at every cut."""

import random

import pytest
from duplika.operators.evaluate import random_sequence
from duplika.sources import fasta
from duplika.sources.fasta_ranges import _Reader, contig_range, index_fasta, read_ranges, scan, write_index
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo


def write(path, contigs, width, newline="\n"):
    lines = lambda s: newline.join(s[i : i + width] for i in range(0, len(s), width))
    path.write_bytes("".join(f">{n}{newline}{lines(s)}{newline if s else ''}" for n, s in contigs).encode())


def contigs_of(seed, lengths):
    rng = random.Random(seed)
    return [(f"chr{i} some >words", random_sequence(n, rng)) for i, n in enumerate(lengths)]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_index_at_every_cut(tmp_path, newline):
    file = tmp_path / "g.fa"
    contigs = contigs_of(1, [37, 0, 10, 1, 20, 55])
    write(file, contigs, 10, newline)
    size = file.stat().st_size
    whole = list(scan(str(file), 0, size))
    assert [(r[1], r[2]) for r in whole] == [(n.split()[0], len(s)) for n, s in contigs]
    raw = file.read_bytes()
    for r, (_, s) in zip(whole, contigs):
        if s:
            assert raw[r[3] : r[3] + 1] == s[:1].encode() and (len(s) < 10 or (r[4], r[5]) == (10, 10 + len(newline)))
    for cut in range(1, size):
        for block in (3, 64):
            assert [*scan(str(file), 0, cut, block), *scan(str(file), cut, size, block)] == whole


def test_uneven_lines_are_refused(tmp_path):
    for body in ("ACGT\nAC\nACGT\n", "AC GT\nACGT\n", "ACGT\n\nACGT\n", "AC\nACGT\n"):
        file = tmp_path / "bad.fa"
        file.write_text(f">a\nACGT\n>b\n{body}")
        with pytest.raises(ValueError, match="b: lines of uneven length"):
            list(scan(str(file), 0, 1000))
    file.write_text(">a\nACGT\nAC\n\n\n>b\nACGT")
    assert [(r[1], r[2]) for r in scan(str(file), 0, 1000)] == [("a", 6), ("b", 4)]


def test_rows_equal_the_files(spark, tmp_path):
    folder = tmp_path / "genomes"
    folder.mkdir()
    held = {"one": contigs_of(2, [1003, 0, 64, 2500]), "t#wo": contigs_of(3, [7, 777])}
    for n, (stem, contigs) in enumerate(held.items()):
        write(folder / f"{stem}.fa", contigs, 60 if n else 61)
    (folder / "empty.fa").write_text("")
    want = {(s.replace("#", ""), n.split()[0]): q for s, c in held.items() for n, q in c if q}
    for path in (str(folder), f"file://{folder}"):
        assert write_index(spark, path, partition_bytes=500) == 6
        for row_bases, partition_bytes in ((100, 333), (64, 10_000), (5000, 50)):
            rows = read_ranges(spark, path, row_bases, partition_bytes).collect()
            assert all(r.start % row_bases == 0 and 0 < len(r.seq) <= row_bases for r in rows)
            got = {}
            for r in sorted(rows, key=lambda r: r.start):
                assert len(got.setdefault((r.species, r.chrom), "")) == r.start
                got[r.species, r.chrom] += r.seq
            assert got == want
    whole = {(r.species, r.chrom): r.seq for r in fasta.read_fasta(spark, f"{folder}/*.fa").collect() if r.seq}
    assert whole == want


def test_filters_reach_the_bytes(spark, tmp_path):
    file = tmp_path / "g.fa"
    contigs = contigs_of(4, [5000, 9000, 3000])
    write(file, contigs, 80)
    assert write_index(spark, str(file)) == 3
    rows = read_ranges(spark, str(file), 1000, 2000)
    got = rows.where("chrom = 'chr1' AND start >= 3000 AND start < 5000").collect()
    assert sorted(r.start for r in got) == [3000, 4000]
    assert sorted(r.chrom for r in rows.where("chrom IN ('chr0', 'chr2', 'none')").select("chrom").distinct().collect()) == ["chr0", "chr2"]
    reader = _Reader({"path": str(file), "rowbases": "1000", "partitionbytes": "100000"})
    assert list(reader.pushFilters([EqualTo(("chrom",), "chr2"), EqualTo(("species",), "g")])) == [EqualTo(("species",), "g")]
    (part,) = reader.partitions()
    assert 3000 <= sum(e - b for _, b, e in part.ranges) <= 3100
    for start, length in ((0, 10), (995, 10), (2500, 4000), (8990, 100)):
        (r,) = contig_range(spark, str(file), "chr1", start, length, 1000).collect()
        assert r.seq == contigs[1][1][start : start + length]
    assert contig_range(spark, str(file), "chr1", 9000, 5, 1000).count() == 0
    # A contig whose index is wrong cannot be read; one asked for by name is read without it.
    index = tmp_path / "g.fa.fai"
    index.write_text(index.read_text().replace("chr2\t3000", "chr2\t9999"))
    with pytest.raises(PySparkException, match="does not fit chr2"):
        rows.collect()
    assert rows.where("chrom = 'chr1'").count() == 9


def test_a_file_without_index(spark, tmp_path):
    file = tmp_path / "g.fa"
    write(file, contigs_of(5, [100]), 80)
    with pytest.raises(PySparkException, match="has no index"):
        read_ranges(spark, str(file)).collect()
    assert [(r.chrom, r.len) for r in index_fasta(spark, str(file)).collect()] == [("chr0", 100)]
