"""What a request has to bring along, checked in a fixed order before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

#: Parameters without which a request is refused, in the order in which they are looked at.
INGEST = ("session_id", "embedding_provider", "embedding_model", "embedding_key")
QUERY = ("session_id", "query", "llm_provider", "llm_model", "llm_key")


@dataclass(frozen=True)
class Checked:
    """ok, or the rule that a request broke: which parameter (the first one, if several) and the status that says so."""

    rule: str = "ok"
    parameter: str | None = None
    status: int = 200

    @property
    def ok(self) -> bool:
        return self.status == 200


OK = Checked()


@dataclass(frozen=True)
class State:
    """What is known of a session when a request comes: whether it has uploaded files, documents that were taken in, and an
    embedder from an ingest."""

    files: bool = False
    documents: bool = False
    embedder: bool = False


def missing(request: Mapping, names: tuple[str, ...]) -> Checked:
    """A parameter that isn't there, is null or is empty counts as missing."""
    absent = next((n for n in names if not request.get(n)), None)
    return OK if absent is None else Checked("missing", absent, 400)


def _of_session(request: Mapping, names: tuple[str, ...], find: Callable[[str], State | None]) -> tuple[Checked, State | None]:
    found = missing(request, names)
    if not found.ok:
        return found, None
    state = find(request["session_id"])
    return (OK if state is not None else Checked("no such session", "session_id", 404)), state


def ingest_request(request: Mapping, find: Callable[[str], State | None]) -> Checked:
    """find: a session's state by its id, null where there is none."""
    found, state = _of_session(request, INGEST, find)
    return found if not found.ok or state.files else Checked("no files", "session_id", 400)


def query_request(request: Mapping, find: Callable[[str], State | None]) -> Checked:
    """A session that has no embedder needs a key for one."""
    found, state = _of_session(request, QUERY, find)
    if not found.ok:
        return found
    if not state.documents:
        return Checked("no documents", "session_id", 400)
    return OK if state.embedder or request.get("embedding_key") else Checked("missing", "embedding_key", 400)
