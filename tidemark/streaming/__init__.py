"""Streams into and out of a lake. A version is an offset, so a change stream is exactly a walk along the commit log."""
