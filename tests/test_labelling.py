from undertow.operators import labelling as lb
from undertow.sources import files


def test_requests_and_cost(spark):
    df = spark.createDataFrame([(1, "a {b}", None), (None, "x", "y")], "record_id long, a string, b string")
    assert [tuple(r) for r in lb.requests(df, "Say {a}, {b}, {c}. {a}", ("a", "b")).collect()] == [("1", "Say a {b}, , {c}. a {b}")]
    cost = lb.estimate_cost(spark.range(216_604)).collect()[0]
    assert (round(cost.dollars, 2), round(cost.batch_dollars, 2), round(cost.minutes)) == (155.95, 77.98, 2407)


def test_calls_try_again_and_report_errors(spark):
    def make():
        seen = {}

        def client(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or prompt == "late" and seen[prompt] < 3:
                raise ValueError(prompt)
            return f"{prompt} {seen[prompt]}"

        return client

    asked = spark.createDataFrame([("1", "good"), ("2", "late"), ("3", "bad"), ("4", None)], "record_id string, prompt string").coalesce(1)
    got = {r.record_id: (r.response, r.error) for r in lb.call_model(asked, make, sleep=lambda s: None).collect()}
    assert got == {"1": ("good 1", None), "2": ("late 3", None), "3": (None, "ValueError: bad"), "4": ("None 1", None)}


class Service:
    def __init__(self, spark, room):
        self.spark, self.room, self.rows, self.failed = spark, room, {}, False

    def submit(self, rows):
        if not self.room:
            raise lb.RateLimited
        if not self.failed:
            self.failed = True
            raise OSError("once")
        self.room -= 1
        self.rows[str(len(self.rows))] = [r.id for r in rows.collect()]
        return str(len(self.rows) - 1)

    def ended(self, batch_id):
        return True

    def fetch(self, batch_id, path):
        self.spark.createDataFrame([(i,) for i in self.rows[batch_id]], "id long").write.parquet(path)


def test_chunks_run_to_their_end(spark, tmp_path):
    files.write_chunks(spark.range(60), str(tmp_path / "in"), 4, "id")
    asked, service, kept = spark.read.parquet(str(tmp_path / "in")), Service(spark, 2), []
    m = lb.step(lb.Manifest.of(4), service, asked, str(tmp_path / "out"), lambda m: kept.append(m.dumps()))
    assert [c.state for c in m.chunks] == ["pending", "submitted", "submitted", "pending"] and m.chunks[0].error == "OSError: once"
    m, service.room = lb.Manifest.loads(kept[-1]), 9
    while not m.complete:
        m = lb.step(m, service, asked, str(tmp_path / "out"))
    assert len(service.rows) == 4
    assert sorted(r.id for r in files.read_chunks(spark, str(tmp_path / "out"), [0, 1, 2, 3]).collect()) == list(range(60))
