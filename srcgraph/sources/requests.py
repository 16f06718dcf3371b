"""Change requests: the body of a service call as a row of the change log, and the answer's form."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

#: Method -> change type.
TYPES = {"POST": "SOURCE_ADDED", "PUT": "SOURCE_MODIFIED", "DELETE": "SOURCE_DELETED"}


def change_of(method: str, body: dict) -> dict:
    """A change row; a blank path is no request. Blank entries of the paths are left out."""
    path = (body.get("projectFilePath") or "").strip()
    if not path:
        raise ValueError("projectFilePath must not be blank")
    if method not in TYPES:
        raise ValueError(f"no such method: {method}")
    some = lambda key: [x for x in body.get(key) or [] if x]
    return {
        "eventId": str(uuid.uuid4()),
        "projectName": body.get("projectName"),
        "absoluteFilePath": body.get("absoluteFilePath"),
        "gitRepoUrl": body.get("gitRepoUrl"),
        "gitBranch": body.get("gitBranch"),
        "classpathEntries": some("classpathEntries"),
        "sourcepathEntries": some("sourcepathEntries"),
        "oldFileIdentifier": None if method == "POST" else path,
        "newProjectFilePath": None if method == "DELETE" else path,
        "changeType": TYPES[method],
        "language": "java",
        "timestamp": datetime.now(timezone.utc).replace(tzinfo=None),
    }


def answer(code: int, message: str, data=None) -> dict:
    return {"code": code, "message": message, "data": data}
