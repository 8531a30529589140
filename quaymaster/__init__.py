"""Quaymaster: dependency-exposure analytics as PySpark DataFrame programs."""

__version__ = "0.1.0"
__all__ = ["ExposureGraph", "__version__"]


def __getattr__(name: str):
    if name == "ExposureGraph":  # only when asked for, so that workers import little
        from .engine import ExposureGraph

        return ExposureGraph
    raise AttributeError(name)
