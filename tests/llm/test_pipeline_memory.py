import corpus_pipeline
from almanac.llm import near_dedup


def test_stages_and_steps_give_the_drivers_memory_back(spark, monkeypatch):
    calls = {"stages": 0, "steps": 0}

    def counted(name):
        def run(_):
            calls[name] += 1

        return run

    monkeypatch.setattr(corpus_pipeline, "release", counted("stages"))
    monkeypatch.setattr(near_dedup, "release", counted("steps"))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert calls["stages"] == len(corpus_pipeline.STAGES) and calls["steps"] >= 6
