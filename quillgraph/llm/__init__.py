"""Training-data operators: each module is self-contained and imports only from this subpackage."""
