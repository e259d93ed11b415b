"""End-to-end plans composed from the operators (one lazy DataFrame each)."""
