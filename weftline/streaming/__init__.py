"""What arrives bit by bit."""
