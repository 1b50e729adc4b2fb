"""Model calls: attempts, timeouts, equal prompts asked once, runs that break and go on."""

import os
import time
import uuid

import pytest

from docquarry.operators.calls import Client, answers, ask

ROWS = [(i, f"prompt {i % 20}") for i in range(60)] + [(100, None), (101, ""), (102, "x" * 50_000)]


def _prompts(spark):
    return spark.createDataFrame(ROWS, "id long, prompt string")


def _scripted(folder, fails=None):
    """A model that notes each call as a file; ``fails`` may raise or end the worker."""

    def model(prompt):
        seen = len([n for n in os.listdir(folder) if n.startswith(prompt[:12].replace(" ", "_") + "-")])
        open(os.path.join(folder, f"{prompt[:12].replace(' ', '_')}-{uuid.uuid4().hex}"), "w").close()
        if fails:
            fails(prompt, seen)
        return prompt.upper()

    return model


def test_each_prompt_is_asked_once(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")
    os.mkdir(calls)
    for _ in range(2):
        got = {r.id: r for r in ask(_prompts(spark), Client(_scripted(calls)), log, 2).collect()}
        assert all(got[i].answer == f"PROMPT {i % 20}" and got[i].ok for i in range(60)) and got[101].answer == "" and got[101].ok
        assert not got[100].ok and got[100].error is None and got[102].error == "too_long" and got[102].attempts == 0
    assert len(os.listdir(calls)) == 21


def test_attempts_and_timeouts(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")
    os.mkdir(calls)

    def fails(prompt, seen):
        if prompt == "prompt 3" and seen < 2:
            raise ConnectionError
        if prompt == "prompt 4":
            raise ValueError
        if prompt == "prompt 5" and seen < 1:
            time.sleep(2)

    client = Client(_scripted(calls, fails), timeout=0.5, attempts=3, pause=0.01)
    got = {r.prompt: r for r in ask(_prompts(spark), client, log, 1).collect()}
    assert (got["prompt 3"].answer, got["prompt 3"].attempts) == ("PROMPT 3", 3)
    assert (got["prompt 4"].ok, got["prompt 4"].attempts, got["prompt 4"].error) == (False, 3, "ValueError")
    assert got["prompt 5"].answer == "PROMPT 5" and got["prompt 5"].attempts == 2
    n = len(os.listdir(calls))
    again = {r.prompt: r for r in ask(_prompts(spark), Client(_scripted(calls), pause=0.01), log, 1).collect()}
    assert again["prompt 4"].answer == "PROMPT 4" and len(os.listdir(calls)) == n + 1


def test_a_run_that_breaks_goes_on(spark, tmp_path):
    """A worker that dies takes its wave with it; the waves before stay, and are not asked again."""
    calls, log, mark = str(tmp_path / "calls"), str(tmp_path / "log"), str(tmp_path / "died")
    os.mkdir(calls)

    def dies(prompt, _):
        if len(os.listdir(calls)) > 12 and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)

    with pytest.raises(Exception):
        ask(_prompts(spark), Client(_scripted(calls, dies), parallel=1), log, 6)
    kept = answers(spark, log).where("ok").count()
    before = len(os.listdir(calls))
    assert 0 < kept < 21 and os.path.exists(mark)
    assert ask(_prompts(spark), Client(_scripted(calls, dies)), log, 6).where("ok").count() == 61
    assert len(os.listdir(calls)) == before + 21 - kept
