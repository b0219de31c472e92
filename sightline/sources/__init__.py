"""Tables from raw inputs."""
