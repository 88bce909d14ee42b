"""The append-only event stream."""
