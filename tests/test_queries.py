import os
import re

import pytest

import __spark_entry__ as entry
from duplika.plans import queries
from duplika.plans.queries import ORACLE_SQL, QUERIES

from .oracle import DATA, both

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLE_SQL[name])
    assert got == want


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["chrom_a", "chrom_b", "shared"]


def test_workflow_queries(spark):
    seqs = {r.chrom: r.seq for r in queries._corpus(spark, DATA).collect()}
    rows = QUERIES["align_pairs"](spark, DATA).collect()
    assert rows
    for r in rows:
        x, y = seqs[r.chr1][r.start1 : r.end1], seqs[r.chr2][r.start2 : r.end2]
        y = y if r.strand2 == "+" else y.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        i = j = wrong = gaps = 0
        for n, op in re.findall(r"(\d+)([MID])", r.cigar):
            n = int(n)
            if op == "M":
                wrong += sum(a != b or a not in "ACGT" for a, b in zip(x[i : i + n], y[j : j + n], strict=True))
            else:
                gaps += n
            i, j = i + n * (op != "D"), j + n * (op != "I")
        assert (i, j) == (len(x), len(y)) and r.max_len == max(i, j)
        assert abs(r.score - 100 * (wrong + gaps) / r.aln_len) < 0.0501
    assert set(QUERIES["chain_dp"](spark, DATA).columns) >= {"x_start", "x_end", "y_start", "y_end"}
