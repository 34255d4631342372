"""Requests and the rules that they break; what is left of the package where an optional module is missing."""

import os
import subprocess
import sys

import pytest

from paperloom.plans.checks import State, ingest_request, query_request

SESSIONS = {"new": State(), "files": State(files=True), "done": State(True, True, True), "loaded": State(documents=True)}
INGEST = {"session_id": "files", "embedding_provider": "p", "embedding_model": "m", "embedding_key": "k"}
QUERY = {"session_id": "done", "query": "q", "llm_provider": "p", "llm_model": "m", "llm_key": "k"}


@pytest.mark.parametrize(
    ("check", "request_", "want"),
    [
        (ingest_request, INGEST, ("ok", None, 200)),
        (ingest_request, INGEST | {"embedding_model": ""}, ("missing", "embedding_model", 400)),
        (ingest_request, INGEST | {"embedding_key": None, "embedding_provider": None}, ("missing", "embedding_provider", 400)),
        (ingest_request, {}, ("missing", "session_id", 400)),
        (ingest_request, INGEST | {"session_id": "gone"}, ("no such session", "session_id", 404)),
        (ingest_request, INGEST | {"session_id": "gone", "embedding_key": ""}, ("missing", "embedding_key", 400)),
        (ingest_request, INGEST | {"session_id": "new"}, ("no files", "session_id", 400)),
        (query_request, QUERY, ("ok", None, 200)),
        (query_request, {k: v for k, v in QUERY.items() if k != "query"}, ("missing", "query", 400)),
        (query_request, QUERY | {"session_id": "gone"}, ("no such session", "session_id", 404)),
        (query_request, QUERY | {"session_id": "files"}, ("no documents", "session_id", 400)),
        (query_request, QUERY | {"session_id": "loaded"}, ("missing", "embedding_key", 400)),
        (query_request, QUERY | {"session_id": "loaded", "embedding_key": "k"}, ("ok", None, 200)),
    ],
)
def test_requests(check, request_, want):
    got = check(request_, SESSIONS.get)
    assert (got.rule, got.parameter, got.status) == want and got.ok == (want[2] == 200)


def test_queries_stay_where_an_optional_module_is_missing():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len([k for k in q if k[:2] == 'q_']), len(q), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}, capture_output=True, text=True)
    some, every, sql = map(int, got.stdout.split())
    assert some == every >= 54 and sql >= 54
