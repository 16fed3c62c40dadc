"""tracelake: serving-trace and document-layout analytics as PySpark jobs."""

from tracelake.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
