"""Tables in the folder that the driver and all executors share."""

from quire.shared import CLEANUP, folder, remove, written

__all__ = ["CLEANUP", "folder", "remove", "written"]
