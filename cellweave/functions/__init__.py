"""Cell-wise mathematics."""

from .mathops import absolute, cos, exp, log, log10, power, rounded, sin

__all__ = ["absolute", "cos", "exp", "log", "log10", "power", "rounded", "sin"]
