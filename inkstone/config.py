"""Configuration, read and validated on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .errors import ConfigError


def env_bool(name: str, default: bool = False) -> bool:
    """A boolean from the environment: 1, true, yes and on (in any case) are true, other values false."""
    value = os.environ.get(name)
    return default if value is None else value.strip().casefold() in {"1", "true", "yes", "on"}


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


@dataclass(frozen=True)
class SplitConfig:
    """Chunk sizes in code points, and the sentences that a part repeats of the one before.

    A title that leaves no room for text is an error of its document; with keep_long_titles the document keeps all its sections, and the
    text below such a title is cut as far as it can be, into its characters and its atomic blocks, each below the title. White space at the
    ends of pieces goes: all that Unicode calls so, or the characters in spaces.
    """

    max_length: int = 2000
    min_length: int = 500
    overlap: int = 1
    keep_long_titles: bool = False
    spaces: str | None = None

    def __post_init__(self) -> None:
        if not (_whole(self.max_length) and _whole(self.min_length) and self.max_length > self.min_length > 0):
            raise ConfigError("max_length must be above min_length, both positive whole numbers", "split")
        if not _whole(self.overlap) or self.overlap < 0:
            raise ConfigError("overlap must be a whole number from 0", "split")


@dataclass(frozen=True)
class ImageConfig:
    """What the image stage needs: extensions, context size, and the services it talks to."""

    extensions: frozenset[str] = frozenset({".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"})
    context: int = 200
    model: str = field(default_factory=lambda: os.environ.get("VL_MODEL", ""))
    requests_per_minute: int = 15
    endpoint: str = field(default_factory=lambda: os.environ.get("MINIO_ENDPOINT", ""))
    secure: bool = field(default_factory=lambda: env_bool("MINIO_SECURE"))
    bucket: str = field(default_factory=lambda: os.environ.get("MINIO_BUCKET_NAME", ""))

    def base_url(self) -> str:
        at = self.endpoint.strip().rstrip("/")
        return at if at.startswith(("http://", "https://")) else f"http{'s' if self.secure else ''}://{at}"

    def checked(self) -> ImageConfig:
        """This configuration, if images can be stored with it."""
        if not self.bucket.strip():
            raise ConfigError("a bucket is missing", "images")
        scheme, _, rest = self.base_url().partition("://")
        if scheme not in ("http", "https") or not rest.split("/")[0]:
            raise ConfigError("the base URL must be an HTTP(S) URL with a host", "images")
        return self
