"""Steps whose cost decides how far the ledger queries scale."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyframe.sources.star import star_base, star_postings
from tallyframe.sources.store import write_store


@pytest.fixture()
def shuffled(spark):
    """Joins of small tables as of large ones."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_the_star_join_leaves_a_transaction_in_one_task(spark, shuffled):
    p = star_postings(star_base(spark, SF_SMALL)).withColumn("task", F.spark_partition_id())
    assert p.select("task").distinct().count() > 1
    assert p.groupBy("txn_id").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


def test_postings_spread_by_transaction_are_stored_where_they_are(spark):
    p = spark.range(0, 4000, 1, 4).select(
        F.lit(1).alias("ledger_id"), F.col("id").alias("txn_id"), F.lit(dt.date(2020, 1, 1)).alias("date"), F.lit("Assets:Hot").alias("account"),
        F.lit(1).cast("decimal(18,2)").alias("number"), F.lit("USD").alias("currency"))
    store = write_store(p, tempfile.mkdtemp(prefix="tf-store-"), by_transaction=True)
    held = store.all().groupBy(F.input_file_name().alias("f")).agg(F.min("txn_id").alias("a"), F.max("txn_id").alias("b"), F.count("*").alias("n")).collect()
    assert sorted((r.a, r.b, r.n) for r in held) == [(0, 999, 1000), (1000, 1999, 1000), (2000, 2999, 1000), (3000, 3999, 1000)]


TEXT = """\
  loose line
option "operating_currency" "USD"
2020-01-01 open Assets:Cash USD
  include_in_dash: "true"
2020-01-02 * "P" "N"; note
  Assets:Cash  -5.00 USD
  Expenses:Food
\f formfeed is white space
2020-01-03 * "Q"

  Assets:Cash  1 GLD {2.5 USD}
  Income:Pay  -2.5 USD
2020-01-04 price GLD 3 USD"""


def _cut(lines, size, alone=False, most=None, monkeypatch=None):
    import pyarrow as pa

    from tallyframe.sources import cutter as lt

    if most:
        monkeypatch.setattr(lt, "MOST_LINES", most)
    t = pa.table({"file": [f for f, _, _ in lines], "split": pa.array([s for _, s, _ in lines], pa.int64()), "line": [x for _, _, x in lines]})
    return [r for b in lt.cutter(["file", "split"], alone)(iter(t.to_batches(max_chunksize=size))) for r in b.to_pylist()]


def test_blocks_are_cut_alike_whatever_the_batches(monkeypatch):
    lines = [(f, s, x) for f, s in [("a", 0), ("a", 9), ("b", 0)] for x in TEXT.split("\n")]
    want = _cut(lines, 10_000)
    assert [r["head"] is None for r in want[:2]] == [True, False] and want[0]["body"] == ["  loose line"]
    for r in want:
        at = [x for f, s, x in lines if (f, s) == (r["file"], r["split"])]
        assert not r["opened"] or at[r["block"] - 1] == r["head"]
        assert at[r["start"] - 1:r["start"] - 1 + len(r["body"])] == r["body"]
    assert sum(r["last"] for r in want) == 3 and sum(len(r["body"]) + r["opened"] for r in want) == len(lines)
    assert not any(r["whole"] for r in want if r["last"] or r["head"] is None)
    for size in (1, 2, 3, 7):
        assert _cut(lines, size) == want
    parts = _cut(lines, 2, most=2, monkeypatch=monkeypatch)     # long blocks are several rows
    assert len(parts) > len(want) and [x for r in parts for x in ([r["head"]] if r["opened"] else []) + r["body"]] == [x for _, _, x in lines]
    assert {(r["block"], r["head"]) for r in parts} == {(r["block"], r["head"]) for r in want}
    whole = [r for r in parts if r["whole"]]
    assert whole and all(r in want for r in whole)


def test_lines_are_not_shuffled_to_find_their_headers(spark, tmp_path):
    from tallyframe.sources.ledger_text import cut_blocks, load_ledger, load_ledger_text, read_ledger_lines

    (tmp_path / "l.ledger").write_text(TEXT)
    plan = cut_blocks(read_ledger_lines(spark, str(tmp_path / "l.ledger")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    for t in (load_ledger(spark, str(tmp_path / "l.ledger")), load_ledger_text(spark, {"l": TEXT})):
        got = sorted((r.txn_id, r.line_no, r.account, float(r.number), r.currency, r.payee, r.narration) for r in t.postings.collect())
        assert got == [(5, 6, "Assets:Cash", -5.0, "USD", "P", "N"), (5, 7, "Expenses:Food", 5.0, "USD", "P", "N"),
                       (9, 11, "Assets:Cash", 1.0, "GLD", None, "Q"), (9, 12, "Income:Pay", -2.5, "USD", None, "Q")]
        assert sorted((r.line_no, r.kind) for r in t.errors.collect()) == [(1, "unparsed_line"), (8, "unparsed_line")]


def test_a_transaction_over_a_split_keeps_its_amounts(spark, tmp_path):
    from tallyframe.sources.ledger_text import load_ledger

    n = 300
    (tmp_path / "l.ledger").write_text("".join(f'2020-01-01 * "t{i}"\n  Assets:Cash  {i + 1} USD\n  Income:Pay\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r.line_no, r.txn_id, r.narration, int(r.number)) for r in load_ledger(spark, str(tmp_path / "l.ledger")).postings.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(3 * i + 2 + k, 3 * i + 1, f"t{i}", (i + 1) * (1 - 2 * k)) for i in range(n) for k in (0, 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rendered_legs_meet_in_one_shuffle(spark):
    """Nothing is collected, or sorted, before the shuffle; repeated and null rows stay."""
    from tallyframe.sources.star import star_ledger_opens, star_ledger_text

    row = lambda txn, account, number, payee="P": (1, txn, 1, dt.date(2020, 1, 2), payee, "N", account, Decimal(number), "USD", None, None, None)
    rows = [row(1, "Assets:B", "-5.00"), row(1, "Assets:A", "5.00"), row(2, "Assets:A", "1.00"), row(2, "Assets:A", "1.00"),
            row(3, "Assets:A", "2.00", None), row(None, "Assets:A", "3.00"), row(None, "Assets:A", "4.00")]
    p = spark.createDataFrame(rows, "ledger_id int, txn_id long, line_no int, date date, payee string, narration string, account string, "
                              "number decimal(18,2), currency string, cost_number decimal(18,2), cost_currency string, cost_date date")
    head = '2020-01-02 * "P" "N"\n'
    want = sorted([head + "  Assets:A  5.00 USD\n  Assets:B  -5.00 USD\n", head + "  Assets:A  1.00 USD\n  Assets:A  1.00 USD\n",
                   "  Assets:A  2.00 USD\n", head + "  Assets:A  3.00 USD\n  Assets:A  4.00 USD\n"])
    for by in ((), ("payee",)):
        text = star_ledger_text(p, *by)
        plan = _plan(text)
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan
        assert sorted(r.block for r in text.collect()) == want
    opens = star_ledger_opens(p)
    assert sorted(r.block for r in opens.collect())[:2] == ["1900-01-01 open Assets:A USD\n", "1900-01-01 open Assets:B USD\n"]


def test_rows_with_a_label_of_their_own_are_rendered_where_they_are(spark, shuffled, tmp_path):
    """The text is that of the postings; repeated labels, null values and other kinds included."""
    from tallyframe.sources.star import mark_alone, star_base_text, star_ledger_text

    base = star_base(spark, SF_SMALL)
    marked = mark_alone(base)
    assert _plan(marked).count("Exchange") == _plan(base).count("Exchange")
    few = base.where("txn_id < 60")
    nulls = [few.withColumn(c, F.lit(None).cast(t)) for c, t in few.dtypes if c not in ("partkey", "ship_date", "segment", "ptype", "brand")]
    rows = few
    for x in [few.where("line_no < 4"), few.where("txn_id < 20").withColumn("amt", F.col("amt") + 1), few.where("txn_id < 9").withColumn("kind", F.lit("X")),
              *(x.withColumn("txn_id", F.col("txn_id") + 1000 * (i + 1)) for i, x in enumerate(nulls) if "txn_id" in x.columns)]:
        rows = rows.unionByName(x)
    mark_alone(rows).write.parquet(str(tmp_path / "base"))
    kept = spark.read.parquet(str(tmp_path / "base"))
    assert {r.alone for r in kept.select("alone").distinct().collect()} == {True, False}
    show = lambda t: sorted((str(r.ledger_id), r.block) for r in t.collect())
    want = show(star_ledger_text(star_postings(rows)))
    assert want and show(star_base_text(kept)) == want
    assert "Exchange" not in _plan(star_base_text(kept.where("alone"))).split("Union")[1].split("Scan parquet")[0]


def test_blocks_without_a_header_run_on_the_block_that_their_shuffle_puts_before_them(spark, shuffled, tmp_path):
    from tallyframe.plans.registry import LEDGER_TABLES, _text_files, ledger
    from tallyframe.sources.star import star_ledger_text

    for t in LEDGER_TABLES:
        x = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        x = x.withColumn("p_name", F.when(F.col("p_partkey") % 7 > 0, F.col("p_name"))) if t == "part" else x
        x.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    src, _ = _text_files(spark, str(tmp_path))
    blocks = star_ledger_text(ledger(spark, str(tmp_path)).postings).withColumn("task", F.spark_partition_id()).collect()
    want = {}
    for r in blocks:
        want[r.task, r.ledger_id] = want.get((r.task, r.ledger_id), "") + r.block + "\n"
    assert any(r.block.startswith(" ") for r in blocks)
    assert set(want.values()) <= {r.value for r in spark.read.text(src, wholetext=True).collect()}


def test_lines_of_postings_are_read_once(spark):
    """One pattern cuts a line as POSTING_RE does; sure lines are not read for errors."""
    from pyspark.sql import functions as F

    from tallyframe.sources.ledger_text import CUT, ELIDED_RE, POSTING_RE, SURE_RE, _posted, load_ledger_text

    lines = ["  Assets:Cash  5.00 USD", "\tAssets:Cash 5 USD ; c", "  ! Assets:A-b_c:9", "  Assets:Cash  5 USD \u2028", "  Assets:Cash  \u00e9 5 USD\u0085 ",
             "  Assets:Cash\t10 GLD {100 USD, 2020-01-02}", "  Assets:Cash 1 GLD {{5 USD}} @ 3 USD", "  Assets: 5 USD", "  key: \"v\"", "Assets:Cash 5 USD",
             "  Assets:Cash;x", "  Assets:Cash x\x01y ", "\x01Assets:Cash\x015", "  Assets:Cash  1 USD {1}", "  Assets:Cash  1.123456789 USD", ""]
    t = spark.createDataFrame([(x,) for x in lines], "line string")
    got = t.select("line", _posted(F.col("line")).alias("p"), F.col("line").rlike(POSTING_RE).alias("is"), F.regexp_extract("line", POSTING_RE, 1).alias("a"),
                   F.regexp_extract("line", POSTING_RE, 2).alias("s")).collect()
    for r in got:
        if r["is"]:
            assert r.p[1:].split(CUT, 1)[0] == r.a and r.p[1:].split(CUT, 1)[1].rsplit(CUT, 1)[0] == r.s, r
        else:
            assert r.p == r.line
    assert t.where(F.col("line").rlike(SURE_RE) & F.col("line").rlike(ELIDED_RE)).count() == 0
    tables = load_ledger_text(spark, {"l": '2020-01-02 * "P" "N"\n' + "\n".join(x for x in lines if x[:1] in " \t")})
    kinds = {r.message: r.kind for r in tables.errors.collect()}
    assert kinds["  Assets:Cash x\x01y "] == kinds["  Assets:Cash  1.123456789 USD"] == "unparsed_amount"
    assert kinds["  Assets:Cash  1 USD {1}"] == "unparsed_cost" and kinds["  Assets: 5 USD"] == "unparsed_line"
    assert not {"  Assets:Cash  5.00 USD", "  Assets:Cash\t10 GLD {100 USD, 2020-01-02}"} & set(kinds)
    assert "regexp_extract(line" not in _plan(tables.postings)


def test_plain_transactions_are_read_as_they_are_cut(spark):
    """Rows of plain transactions hold typed postings and no lines; all tables are those of the general patterns,
    which read the same text with another flag."""
    import dataclasses

    from tallyframe.sources.ledger_text import cut_blocks, load_ledger_text, text_lines

    legs = ["  Assets:Cash  5.00 USD", "\tAssets:Cash\t+5 USD  ", "  ! Assets:A-b_c:9 -1234567890.12345678 EUR", "  Assets:Lot  10 GLD {100.5 USD, 2020-01-31}",
            "  Assets:Lot  10 GLD{7 USD}", "  Assets:Lot  1 GLD { 2 USD , 2019-02-28 }  ", "  Assets:Cash  0 USD"]
    odd = ["  Assets:Cash  12345678901 USD", "  Assets:Cash  1.123456789 USD", "  Assets:Lot  1 GLD {2 USD, 2019-02-31}", "  Assets:Lot  1 GLD {2 USD, \"lot\"}",
           "  Assets:Lot  1 GLD {{2 USD}}", "  Assets:Cash  1 USD @ 2 EUR", "  Assets:Cash  1 USD ; c", "  Assets:Cash  1,000 USD", "  Assets:Cash 5. USD", "  Assets:Cash", "  key: 1",
           "  Assets:Cash x", "  Assets:Cash  1 USD \u2028", "  Assets:Cash  1 A.B"]
    heads = ['2020-01-02 * "P" "N"', '2020-02-28 *  "N é"', '2020-12-31 * "P"  ""', '2020-02-29 * "leap"', '2021-02-29 * "no day"', '2020-1-2 * "N"', '2020-01-02 * "" "N"',
             '2020-01-02 * "P" "N" #tag', '2020-01-02 * "P" "N;" ; c', '2020-01-02 * "a \\" b"', '2020-01-02 * "P""N"', '2020-01-02 * N', '2020-01-02 * "a\u2028b"']
    texts = ["\n".join([h, "  ; comment", *legs, "", *x]) for h in heads for x in ([], odd[:1])] + [f"{heads[0]}\n{legs[0]}\n{x}\n{legs[1]}" for x in odd] + [heads[0]]
    texts = {str(i): f"{x}\n2020-01-03 open Assets:Cash" for i, x in enumerate(texts)}
    rows = cut_blocks(text_lines(spark.createDataFrame(list(texts.items()), "ledger_id string, text string"))).where("kind = 'transaction'").collect()
    assert sorted(int(r.ledger_id) for r in rows if r.narration is not None) == [0, 2, 4, len(texts) - 1]
    assert all((r.narration is None) != (r.head is None and not r.body) and (r.narration is None) == (r.hdr.rest is not None) for r in rows)
    assert {len(r.legs) for r in rows if r.ledger_id in "024"} == {len(legs)}
    got, want = load_ledger_text(spark, texts), load_ledger_text(spark, {k: x.replace(" * ", " txn ", 1) for k, x in texts.items()})
    for f in dataclasses.fields(got):
        a, b = getattr(got, f.name), getattr(want, f.name)
        assert a.dtypes == b.dtypes
        show = lambda t: sorted(str(r).replace(" * ", " txn ") for r in t.collect())
        assert show(a) == show(b), f.name


def test_only_postings_of_asserted_types_are_summed_by_day(spark):
    from tallyframe.operators.checks import balance_failures

    day = dt.date(2020, 1, 1)
    rows = [(i, a, c, day, Decimal(n)) for i, a, c, n in [
        (1, "Assets:Cash", "USD", "1.00"), (1, "Assets:Cash:Till", "USD", "2.00"), (1, "Assets", "USD", "4.00"), (1, "Assets:Bank", "USD", "8.00"),
        (1, "Assets:Cash", "EUR", "16.00"), (1, "Income:Pay", "USD", "32.00"), (2, "Assets:Cash", "USD", "64.00"), (1, None, "USD", "128.00"), (1, "AssetsX", "USD", "256.00")]]
    p = spark.createDataFrame(rows, "ledger_id int, account string, currency string, date date, number decimal(18,2)")
    later = dt.date(2020, 1, 2)
    b = spark.createDataFrame([(1, "Assets:Cash", "USD", later, Decimal(0)), (1, "Assets", "USD", later, Decimal(0)), (1, "Income:Pay", "EUR", later, Decimal(0)),
                               (1, None, "USD", later, Decimal(5))], "ledger_id int, account string, currency string, date date, number decimal(18,2)")
    e = balance_failures(p, b)
    assert sorted((str(r.account), int(r.actual)) for r in e.collect()) == [("Assets", 15), ("Assets:Cash", 3), ("None", 0)]
    plan = e._jdf.queryExecution().optimizedPlan().toString().split("\n")
    summed = next(i for i, x in enumerate(plan) if "Aggregate [ledger_id" in x and "delta" in x and "sum(number" in x)
    assert any("Join LeftSemi" in x for x in plan[summed:])
