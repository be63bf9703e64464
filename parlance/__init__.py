"""parlance: labelled-text analytics expressed as Spark DataFrame plans."""

from parlance.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
