"""Readers and writers of signals, events, behaviour logs and the experiment catalog."""
