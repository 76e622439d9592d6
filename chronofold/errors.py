"""Typed errors of sources, ingestion, stores and the stream control plane."""

from __future__ import annotations


class ChronofoldError(Exception):
    """Base of all errors of the library."""


class OffsetFormatError(ChronofoldError, ValueError):
    """Offsets of different formats, or a malformed offset."""


class SourceError(ChronofoldError):
    """A source cannot be read; names stream and position."""

    def __init__(self, message: str, stream: str | None = None, offset: str | None = None):
        super().__init__(f"{message} (stream {stream!r}, offset {offset!r})")
        self.stream, self.offset = stream, offset


class RetentionError(SourceError):
    """The cursor lies before what the log still holds."""


class ResetError(SourceError):
    """The log was reset; state built from it is void."""


class MustRefetchError(SourceError):
    """The log asks for a full read."""


class ControlError(SourceError):
    """The log reported an error frame."""


class CatchUpTimeout(SourceError):
    """Not caught up in time."""


class MapperError(SourceError):
    """A mapper failed on a message."""


class DroppedChangeError(ChronofoldError):
    """A change that is no delete led to no write."""


class ConstraintError(ChronofoldError):
    """A window, endpoint, uniqueness, cardinality or restricted-delete violation."""


class StalePlanError(ChronofoldError):
    """The target moved after the plan was made."""


class CommitConflict(ChronofoldError):
    """Another writer published first."""


class ForkError(ChronofoldError):
    """A fork point is invalid, or the fork exists with another configuration."""


class SubscriptionError(ChronofoldError):
    """Unknown or ill-formed subscription."""


class ClaimedError(SubscriptionError):
    """Another worker holds the lease."""

    def __init__(self, holder: str):
        super().__init__(f"claimed by {holder}")
        self.holder = holder


class FencedError(SubscriptionError):
    """The claim's wake or generation is out of date."""
