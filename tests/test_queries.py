"""Registered queries against their SQL on the smallest folder; all of them with QUADHAP_ALL=1."""

import os

import duckdb
import pytest

from check import canonical
from quadhap.plans import REGISTRY
from quadhap.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
QUICK = ("kmer_support_rank", "dedup_read_names", "assign_reads_to_genes", "two_field_modes", "chi_histogram", "reassign_genotypes", "depth", "mask_intervals",
         "em_gate", "strategy_tallies", "rare_collapse", "phase_pairs", "paired_assembly", "lift_alleles", "quartet_l1", "accepted_rescues", "rescue_family_pairs",
         "cohort_tables", "gene_parameters", "unpaired_assembly", "lowcov_mask", "name_codecs", "slot_fractions", "quartet_af", "em_converged",
         "evidence_fit", "parsed_sequences", "parsed_alignments", "parsed_sites", "parsed_regions", "parsed_mixture", "parsed_manifest", "unique_kmer_index", "rescue_manifest")
NAMES = list(REGISTRY) if os.environ.get("QUADHAP_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    entry = REGISTRY[name]
    df = entry.run(spark, FOLDER)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if entry.sql is None:
        assert got
        return
    cur = con.execute(entry.sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = [tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()]
    assert canonical(got) == canonical(want)


def test_every_query_has_an_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
