"""The summary of a ledger that is cut in buckets, in a session that has run nothing else: there columns have the lowest ids."""

import json
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import json, sys
from catalog import documents
from doppel.operators import order_stats
from doppel.session import local
order_stats.ROWS_PER_BUCKET = 100
spark = local(2, memory="1g", partitions=2)
rows = documents.summary(spark, sys.argv[1]).collect()
print(json.dumps([r.asDict() for r in rows]))
"""


def test_summary_of_a_ledger_in_buckets(tmp_path):
    import duckdb

    from catalog import documents

    con = duckdb.connect()
    con.execute("create table events as select range as event_id, timestamp '2024-01-01' as ts, range % 7 as user_id, "
                "case when range % 3 = 0 then 'purchase' else 'click' end as event_type, (range * 37 % 1000) / 100.0::double as value, '' as props from range(500)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    found = con.execute(documents.ORACLES["statement_summary"])
    want = [dict(zip([c[0] for c in found.description], row)) for row in found.fetchall()]
    out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], capture_output=True, text=True, cwd=ROOT, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    made = json.loads(out.stdout.splitlines()[-1])
    assert sorted(made, key=lambda r: r["account"]) == sorted(want, key=lambda r: r["account"]) and len(made) == 7
