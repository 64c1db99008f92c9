"""What callers ask for, in one place: encode, decode, archives, channels, studies."""

from __future__ import annotations

from .kernels.channel import Channel
from .kernels.frames import PROFILES, Screen
from .kernels.superblock import Superblock, unpack
from .operators.planning import cost, failure_bound, geometry, tolerated_loss
from .operators.screening import Rules, screen, summary
from .operators.simulation import probe
from .plans.archives import Archive, build, extract, locate, needed_groups, opened, verify
from .functions.registry import register as register_functions
from .plans.codec import decode_pool, encode, manifest, read, recover, resolve, scan
from .session import builder, prepare
from .sources import register
from .streaming.detectors import detect
from .streaming.extents import current, read_range, scrub, store

__all__ = [
    "Archive", "Channel", "PROFILES", "Rules", "Screen", "Superblock", "build", "builder", "cost", "current", "decode_pool", "detect", "encode", "extract", "failure_bound", "geometry", "locate",
    "manifest", "needed_groups", "opened", "prepare", "probe", "read", "read_range", "recover", "register", "register_functions", "resolve", "scan", "screen", "scrub", "store", "summary", "tolerated_loss", "unpack", "verify",
]
