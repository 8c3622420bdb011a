"""Part of quorumlake."""
