import json
import pathlib
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shelfgauge.operators import analyse, enrich, responses_of, run_metrics, summary_scalars, with_batch_id
from shelfgauge.operators.calls import CallLog, Slots
from shelfgauge.plans.queries import sample_model
from shelfgauge.schema import MODEL_COLUMNS

# the executors cannot import the test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def products_of(request):
    return json.loads(next(line for line in request.split("\n") if line.startswith("[")))


def answer(products, **changes):
    base = dict.fromkeys(["product_id", *MODEL_COLUMNS])
    base.update(issues=["i"], missing_attributes=[], quality_score=50, grade="D")
    return json.dumps([{**base, "product_id": p["product_id"], **changes} for p in products])


@pytest.fixture
def logged(tmp_path):
    """A model that logs each request in a file of its own, so that calls can be counted."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def build(reply):
        def scorer(request):
            import pathlib
            import uuid

            (pathlib.Path(str(folder)) / uuid.uuid4().hex).write_text(request)
            return reply(request)

        return scorer

    return build, lambda: [path.read_text() for path in pathlib.Path(folder).iterdir()]


def feed_of_ids(feed_of, n):
    return feed_of(*[{"product_id": f"{at:03}"} for at in range(n)])


def test_every_batch_is_asked_once(spark, feed_of, logged):
    build, calls = logged
    done = enrich(feed_of_ids(feed_of, 20), build(lambda r: answer(products_of(r))))
    assert [r.quality_score for r in done.collect()] == [50] * 20
    # later steps read the stored answers and do not call the model again
    assert summary_scalars(done).first().total_products == 20
    assert done.where("grade = 'D'").count() == 20
    assert len(calls()) == 3


def test_failed_batches_are_asked_again_with_the_strict_request(spark, feed_of, logged):
    build, calls = logged

    def reply(request):
        products = products_of(request)
        first = int(products[0]["product_id"]) // 4
        strict = request.startswith("Output raw JSON")
        if first == 0:
            return answer(products)
        if first == 1:
            return answer(products, grade="B") if strict else "no idea"
        if first == 2:
            if strict:
                return answer(products[:2], grade="C")  # short, but a list
            raise ConnectionError("down")
        if first == 3:
            return "{}" if strict else None
        raise RuntimeError("always")

    done = enrich(feed_of_ids(feed_of, 18), build(reply), batch_size=4)
    grades = {r.product_id: (r.grade, r.issues) for r in done.collect()}
    stub = ("F", "LLM analysis failed for this product")
    want = [("D", "i")] * 4 + [("B", "i")] * 4 + [("C", "i")] * 2 + [("F", "Analysis failed")] * 2
    assert [grades[f"{at:03}"] for at in range(18)] == want + [stub] * 6
    strict = [text for text in calls() if text.startswith("Output raw JSON")]
    assert (len(calls()), len(strict)) == (9, 4)


def test_error_texts_are_stored(spark, feed_of, tmp_path):
    def fail(request):
        raise ValueError("quota")

    folder = str(tmp_path / "own")
    results = analyse(
        with_batch_id(feed_of_ids(feed_of, 3), folder=folder), fail, folder=folder, pause=0.01
    )
    assert {(r.attempt, r.product_id) for r in results.collect()} == {(0, f"{n:03}") for n in range(3)}
    stored = responses_of(spark, folder)
    assert {(r.attempt, r.error, r.valid) for r in stored.collect()} == {
        (1, "ValueError: quota", False),
        (2, "ValueError: quota", False),
    }


def test_callers_set_the_number_of_calling_tasks(spark, feed_of, tmp_path):
    folder = tmp_path / "own"

    def scorer(request):
        import os

        return str(os.getpid())

    batched = with_batch_id(feed_of_ids(feed_of, 64), 1, folder=str(folder))
    analyse(batched, scorer, callers=3, folder=str(folder))
    first = folder / "responses-1"
    assert len(list(first.glob("part-*"))) == 3


def test_pause_between_calls(spark, feed_of, tmp_path):
    import time

    batched = with_batch_id(feed_of_ids(feed_of, 4), 1)
    start = time.time()
    analyse(batched, lambda r: answer(products_of(r)), callers=1, pause=0.4)
    assert time.time() - start > 1.2


def test_sample_model(spark, feed_of):
    feed = feed_of({"product_id": "P1", "keywords": None}).withColumn("n", F.lit(None).cast("int"))
    row = enrich(feed, sample_model()).first()
    assert (row.quality_score, row.issues) == (80, "keywords is empty; n is empty")


def test_answers_that_are_no_text_are_unusable(spark, feed_of):
    def reply(request):
        products = products_of(request)
        if products[0]["product_id"] == "000":
            return [1]
        return "\ud800" if products[0]["product_id"] == "001" else answer(products)

    grades = {r.product_id: r.grade for r in enrich(feed_of_ids(feed_of, 3), reply, batch_size=1).collect()}
    assert grades == {"000": "F", "001": "F", "002": "D"}


def test_shared_ids(spark, feed_of):
    feed = feed_of({"title": "a"}, {"title": "b"})
    once = enrich(feed, lambda r: answer(products_of(r)))
    assert sorted(r.title for r in once.collect()) == ["a", "b"]
    assert enrich(feed, lambda r: answer(products_of(r)), first_by=()).count() == 4


def test_feed_columns_named_like_batch_columns_survive(spark, feed_of, logged):
    build, calls = logged
    feed = feed_of({"product_id": "1"}, {"product_id": "2"}).withColumns(
        {"position": F.lit("top"), "batch_id": F.lit("b7"), "item_no": F.col("product_id")}
    )
    rows = enrich(feed, build(lambda r: answer(products_of(r))), order=["item_no"]).collect()
    assert sorted((r.product_id, r.position, r.batch_id, r.item_no, r.grade) for r in rows) == [
        ("1", "top", "b7", "1", "D"), ("2", "top", "b7", "2", "D"),
    ]
    sent = products_of(calls()[0])
    assert [(p["position"], p["batch_id"], p["item_no"]) for p in sent] == [("top", "b7", "1"), ("top", "b7", "2")]


def test_a_run_that_was_stopped_loses_only_the_call_in_flight(spark, feed_of, logged, tmp_path):
    build, calls = logged
    feed, folder = feed_of_ids(feed_of, 12), str(tmp_path / "run")
    broken = tmp_path / "broken"

    def reply(request):
        import os

        if os.path.exists(str(broken)) and "007" in request:
            os._exit(1)  # no answer, the worker is gone
        return answer(products_of(request))

    broken.touch()
    options = {"batch_size": 1, "folder": folder, "callers": 1}
    with pytest.raises(Exception):
        enrich(feed, build(reply), **options)
    broken.unlink()
    before = len(calls())
    assert before > 1
    assert enrich(feed, build(reply), **options).where("grade = 'D'").count() == 12
    assert len(calls()) - before == 12 - (before - 1)
    again = len(calls())
    assert enrich(feed, build(reply), **options).count() == 12 and len(calls()) == again
    told = run_metrics(spark, folder).first().asDict()
    assert told == {"batches": 12, "valid_at_once": 12, "retried": 0, "failed_calls": 0, "stubbed": 0}


def test_logs_hold_whole_lines_only(tmp_path):
    log = CallLog(str(tmp_path), 3, roll=2)
    assert list(log.read()) == []
    for n in range(5):
        log.write({"batch_id": n, "raw": "é\n\u2028" * n})
    log.close()
    files = sorted(tmp_path.glob("shard=3/*"))
    assert len(files) == 3
    with files[0].open("ab") as file:
        file.write(b'{"batch_id": 99, "raw": "to')
    assert sorted(a["batch_id"] for a in CallLog(str(tmp_path), 3).read()) == list(range(5))
    assert list(CallLog(str(tmp_path), 4).read()) == []


@pytest.mark.parametrize("shards, per_minute", [(1, 15), (4, 15), (7, 60), (50, 15)])
def test_all_tasks_together_keep_the_rate(shards, per_minute):
    times = []
    for shard in range(shards):
        now = [1_000_000.0 + 0.37 * shard]

        def sleep(seconds, now=now):
            now[0] += seconds

        slots = Slots(shard, shards, per_minute, clock=lambda now=now: now[0], sleep=sleep)
        for call in range(40):
            slots.wait()
            times.append(now[0])
            now[0] += (call * 7 % 5) * 0.9  # calls take time of their own
    times.sort()
    for at, start in enumerate(times):
        end = at
        while end < len(times) and times[end] < start + 60 - 1e-6:
            end += 1
        assert end - at <= per_minute
    if shards <= per_minute:
        assert (len(times) - 1) / (times[-1] - times[0]) * 60 > per_minute * 0.6


def test_the_rate_holds_in_a_run(spark, feed_of):
    import time

    batched = with_batch_id(feed_of_ids(feed_of, 6), 1)
    start = time.time()
    analyse(batched, lambda r: answer(products_of(r)), callers=3, per_minute=120)
    assert time.time() - start > 1.4


def test_requests_come_to_the_callers_in_small_batches(spark, feed_of, tmp_path, monkeypatch):
    from shelfgauge.operators import enrichment

    seen = tmp_path / "seen"
    seen.mkdir()
    asked = enrichment.ask

    def watched(*given):
        work, place = asked(*given), str(seen)

        def run(frames):
            def told():
                for frame in frames:
                    size = sum(map(len, frame["request"]))
                    pathlib.Path(place, uuid.uuid4().hex).write_text(str(size))
                    yield frame

            return work(told())

        return run

    monkeypatch.setattr(enrichment, "ask", watched)
    long = "word " * 20_000
    feed = feed_of(*({"product_id": f"P{i:03}", "description": long} for i in range(120)))
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = enrichment.enrich(feed, lambda request: "[]", callers=1, folder=str(tmp_path / "run"))
    assert found.count() == 120
    sizes = [int(file.read_text()) for file in seen.iterdir()]
    # 120 products of 100 kB, asked twice
    assert sum(sizes) > 24_000_000 and max(sizes) < 6_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
