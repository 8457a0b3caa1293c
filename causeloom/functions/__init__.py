"""Part of causeloom."""
