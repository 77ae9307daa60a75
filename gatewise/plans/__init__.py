"""The registered queries: each a small plan over the engine's operators, with its SQL."""
