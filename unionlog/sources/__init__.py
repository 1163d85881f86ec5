"""The run layout on disk: store, producer/host facade and cleanup of stale runs."""

from unionlog.sources.reaper import plan_reap, reap  # noqa: F401
from unionlog.sources.store import RunSet, attach, boot_id, create, segment_path  # noqa: F401
from unionlog.sources.transport import Host, Producer  # noqa: F401
