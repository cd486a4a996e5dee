"""The queries; importing the package registers them."""

from gristmill.plans import answers, cells, chunks, diagnostics, dialogue, grading, integrity, retrieval, snapshots, statistics, supervision, texts  # noqa: F401
