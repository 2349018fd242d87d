from pressroom.tracking import Tracker, setup_logging


class Broken:
    def log(self, row):
        raise RuntimeError("no")


def test_a_broken_sink_is_switched_off(tmp_path):
    t = Tracker(Broken())
    t.log({"x": 1})
    assert not t.on
    ok = Tracker(path=str(tmp_path / "m.jsonl"), config={"a": 1})
    ok.log({"mrr": 0.2}, step=3)
    assert (tmp_path / "m.jsonl").read_text().count("\n") == 2


def test_logging_has_no_second_handler(tmp_path):
    a = setup_logging(str(tmp_path / "l"), "one")
    n = len(a.handlers)
    assert len(setup_logging(str(tmp_path / "l"), "one").handlers) == n
    a.info("here")
    assert "here" in (tmp_path / "l").read_text()
