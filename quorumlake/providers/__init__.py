"""Model-backed operators: interfaces, and offline stand-ins."""
