"""Registered queries over the driver's tables, each with its SQL equivalent where SQL can express it."""
